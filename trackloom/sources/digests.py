"""SHA-256 of whole files, read as streams by the executors' JVMs.

Python tasks reach only the stores that pyarrow knows, and Spark's binary source gives a file as one value. So a
small Java function reads a file by Hadoop, from any store that Spark reads, a piece at a time. Janino, the compiler
of Spark's own generated code, compiles it on the driver; executors get its class as a jar of the Spark context.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from py4j.java_gateway import JavaObject
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The piece of a file that a task holds.
PIECE_BYTES = 64 << 10

#: A name of its own for each process: py4j and executors keep classes by name.
NAME = f"FileDigest{uuid.uuid4().hex}"
SOURCE = f"""
import java.io.FileNotFoundException;
import java.io.IOException;
import java.io.InputStream;
import java.security.MessageDigest;
import org.apache.hadoop.fs.Path;
import org.apache.hadoop.hdfs.BlockMissingException;
import org.apache.hadoop.security.AccessControlException;
import org.apache.spark.broadcast.Broadcast;
import org.apache.spark.sql.Column;
import org.apache.spark.sql.api.java.UDF1;
import org.apache.spark.sql.expressions.UserDefinedFunction;
import org.apache.spark.sql.functions;
import org.apache.spark.sql.types.DataTypes;
import org.apache.spark.util.SerializableConfiguration;

public class {NAME} implements UDF1 {{
    private static final long serialVersionUID = 1L;
    private final Broadcast conf;
    private final boolean skipMissing;
    private final boolean skipCorrupt;

    public {NAME}(Broadcast conf, boolean skipMissing, boolean skipCorrupt) {{
        this.conf = conf;
        this.skipMissing = skipMissing;
        this.skipCorrupt = skipCorrupt;
    }}

    public Object call(Object name) throws Exception {{
        try {{
            return digest((String) name);
        }} catch (FileNotFoundException e) {{
            if (skipMissing) return null;
            throw e;
        }} catch (AccessControlException e) {{
            throw e;
        }} catch (BlockMissingException e) {{
            throw e;
        }} catch (IOException e) {{
            if (skipCorrupt) return null;
            throw e;
        }} catch (RuntimeException e) {{
            if (skipCorrupt) return null;
            throw e;
        }}
    }}

    private byte[] digest(String name) throws Exception {{
        Path path = new Path(name);
        MessageDigest digest = MessageDigest.getInstance("SHA-256");
        byte[] piece = new byte[{PIECE_BYTES}];
        InputStream file = path.getFileSystem(((SerializableConfiguration) conf.value()).value()).open(path);
        try {{
            for (int n = file.read(piece); n >= 0; n = file.read(piece)) {{
                digest.update(piece, 0, n);
            }}
        }} finally {{
            file.close();
        }}
        return digest.digest();
    }}

    public Column over(Column path) {{
        UserDefinedFunction f = functions.udf((UDF1) this, DataTypes.BinaryType);
        // Else a filter on the digest would be pushed below it and read the files again.
        return (skipMissing || skipCorrupt ? f.asNondeterministic() : f).apply(new Column[] {{path}});
    }}
}}
"""
LOCK = threading.Lock()
#: By the gateway of a driver's JVM: the class there and its jar.
COMPILED: dict = {}


def digest_class(context: SparkContext) -> JavaObject:
    """The class of SOURCE, compiled once; the executors of ``context`` have its jar."""
    gateway = context._gateway
    with LOCK:
        if gateway not in COMPILED:
            compiler = gateway.jvm.org.codehaus.janino.SimpleCompiler()
            compiler.cook(SOURCE)
            jar = os.path.join(tempfile.mkdtemp(prefix="trackloom-jar-"), f"{NAME}.jar")
            with zipfile.ZipFile(jar, "w") as out:
                out.writestr(f"{NAME}.class", bytes(compiler.getBytecodes()[NAME]))
            COMPILED[gateway] = compiler.getClassLoader().loadClass(NAME), jar
        kind, jar = COMPILED[gateway]
        if NAME not in context._jsc.sc().listJars().mkString(" "):
            context._jsc.addJar(jar)
    return kind


def with_sha256(files: DataFrame) -> DataFrame:
    """Add ``sha256``, in hex, of the file that ``path`` names. A task holds PIECE_BYTES of it, whatever its length.
    Files that fail are errors, or left out as far as the session ignores missing or corrupt files."""
    spark = files.sparkSession
    context, jvm = spark.sparkContext, spark._jvm
    skips = [spark.conf.get(f"spark.sql.files.ignore{what}Files").lower() == "true" for what in ("Missing", "Corrupt")]
    # The Hadoop settings of the session, sent as Spark's own sources send them.
    conf = jvm.org.apache.spark.util.SerializableConfiguration(spark._jsparkSession.sessionState().newHadoopConf())
    given = context._gateway.new_array(jvm.Object, 3)
    given[0], given[1], given[2] = context._jsc.broadcast(conf), *skips
    digest = digest_class(context).getConstructors()[0].newInstance(given)
    out = files.withColumn("sha256", F.lower(F.hex(Column(digest.over(F.col("path")._jc)))))
    return out.where("sha256 IS NOT NULL") if any(skips) else out

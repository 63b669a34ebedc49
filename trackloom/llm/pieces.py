"""SentencePiece encoding and decoding with seeded merge dropout.

The vocabulary is a merge-type model with byte fallback, read on the driver from a path and
broadcast (at most MODEL_BYTES). Encoding follows that type's agenda: all neighbouring symbols
whose joint piece is known are candidates; the best score goes first, the left one of equals, and
a merge adds the candidates it makes. Dropout skips a candidate for good if a keyed hash of the
seed, the document's id, the chunk's position and the candidate's three borders is below the rate:
every occurrence has draws of its own, and the same seed always gives the same segmentation.

No piece holds a space mark after another character, so a text is cut before each run of marks
and around line ends. Equal chunks of a slice are segmented once for each set of skipped candidates,
out of all candidates any order of merges can make; chunks longer than SHORT or found fewer than
OFTEN times occurrence by occurrence.
Chunks of up to SHORT characters are segmented together in arrays, longer ones one by one with a
heap; both give the same pieces.

Decoding is lossless: characters without a piece, and space marks of the text itself, are spelled
in bytes. Without dropout, texts without space marks get the library's own ids.

Defined cases: null and empty texts have no pieces and decode to the empty text; a null id counts
as the text "null"; repeated rows get equal pieces; other columns pass through.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import map_arrow, text_slices
from trackloom.llm.near_dup import mix, unit

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_BYTES = 16 << 20
SEED, DROPOUT = 20, 0.1
SHORT, OFTEN = 32, 32
#: Draws made at once, distinct chunks whose candidates a task remembers, and bytes of text at once.
DRAWS, CHUNK_CACHE, SLICE = 1 << 16, 50_000, 1 << 20
MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Stands for a space mark of the text itself; no valid text holds a lone surrogate.
LITERAL = "\udc81"
NONE = np.int64(1 << 40)


def load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


class Spellings:
    """The bytes of every id, all that decoding needs."""

    def __init__(self, model: bytes):
        proc = load(model)
        plain = lambda i: not (proc.is_control(i) or proc.is_unknown(i) or proc.is_unused(i))
        self.bytes_of = [bytes([int(proc.id_to_piece(i)[3:5], 16)]) if proc.is_byte(i) else
                         proc.id_to_piece(i).replace(MARK, " ").encode() if plain(i) else b"" for i in range(proc.get_piece_size())]
        self.spelling = pa.array(self.bytes_of, pa.large_binary())


class Vocabulary:
    """Pieces and the table of merges."""

    def __init__(self, model: bytes):
        proc = load(model)
        self.model = model
        names = [proc.id_to_piece(i) for i in range(proc.get_piece_size())]
        plain = [i for i in range(len(names)) if not (
            proc.is_byte(i) or proc.is_control(i) or proc.is_unknown(i) or proc.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        if any(MARK in name.lstrip(MARK) or "\n" in name for name in self.ids):
            raise ValueError("a piece goes over a chunk border")
        self.byte_ids = [proc.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scores = sorted({proc.get_score(i) for i in plain}, reverse=True)
        rank_of_score = {s: r for r, s in enumerate(scores)}
        self.rank = np.full(len(names), NONE)
        for i in plain:
            self.rank[i] = rank_of_score[proc.get_score(i)]
        self.size = len(names)
        merges = {}
        for name, i in self.ids.items():
            for cut in range(1, len(name)):
                left, right = self.ids.get(name[:cut]), self.ids.get(name[cut:])
                if left is not None and right is not None:
                    merges[left * self.size + right] = i
        keys = sorted(merges)
        self.pairs, self.joint = np.array(keys, np.int64), np.array([merges[k] for k in keys], np.int64)
        self.merges = merges
        self.held: dict[str, np.ndarray] = {}
        self.chars = {c: i for c, i in self.ids.items() if len(c) == 1}
        self.char_ids = np.full(0x110000, -1, np.int32)
        for c, i in self.chars.items():
            self.char_ids[ord(c)] = i

    @property
    def bytes_of(self) -> list[bytes]:
        return spellings(self.model).bytes_of

    @property
    def spelling(self) -> pa.Array:
        return spellings(self.model).spelling

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of two neighbours, or -1; negative symbols have no piece."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.joint[at], -1)

    def candidates(self, chunk: str) -> np.ndarray:
        """(3, n): the borders, at most SHORT, of all candidates that merges of ``chunk`` can make."""
        if (known := self.held.get(chunk)) is not None:
            return known
        size, found = len(chunk), []
        begun: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for start in range(size - 1, -1, -1):
            spans = {start + 1: self.chars.get(chunk[start], -1)}
            if spans[start + 1] < 0:
                continue
            open_ends = [start + 1]
            for middle in open_ends:
                left = spans[middle] * self.size
                for end, right in begun[middle] if middle < size else ():
                    piece = self.merges.get(left + right)
                    if piece is not None:
                        found.append((start, middle, end))
                        if end not in spans:
                            spans[end] = piece
                            open_ends.append(end)
            begun[start] = list(spans.items())
        if len(self.held) >= CHUNK_CACHE:
            self.held.clear()
        out = self.held[chunk] = np.array(found, np.uint8).reshape(-1, 3).T
        return out

    def spelled(self, char: str) -> list[int]:
        raw = MARK.encode() if char == LITERAL else char.encode()
        return [self.byte_ids[b] for b in raw]


@lru_cache(maxsize=1)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


@lru_cache(maxsize=1)
def spellings(model: bytes) -> Spellings:
    return Spellings(model)


def skipped(keys: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    if rate <= 0:
        return np.zeros(len(keys), bool)
    u = np.uint64
    mixed = start.astype(u) * u(0x9E3779B97F4A7C15) + middle.astype(u) * u(0xC2B2AE3D27D4EB4F) + end.astype(u) * u(0x165667B19E3779F9)
    return unit(mix(keys ^ mix(mixed))) < rate


def segment_long(vocab: Vocabulary, chunk: str, key: int, rate: float) -> list[int]:
    """One chunk by a heap of candidates."""
    size = len(chunk)
    symbol = [vocab.chars.get(c, -1) for c in chunk]
    nxt, prev = list(range(1, size + 1)), list(range(-1, size - 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(starts: list[tuple[int, int]]) -> None:
        made = [(i, j, vocab.merges.get(symbol[i] * vocab.size + symbol[j], -1)) for i, j in starts
                if symbol[i] >= 0 and symbol[j] >= 0]
        made = [m for m in made if m[2] >= 0]
        if made:
            i, j = (np.array([m[x] for m in made], np.int64) for x in (0, 1))
            drop = skipped(np.full(len(made), key, np.uint64), i, j, np.array([nxt[x] for x in j.tolist()], np.int64), rate)
            for (a, b, piece), gone in zip(made, drop.tolist(), strict=True):
                if not gone:
                    heapq.heappush(agenda, (int(vocab.rank[piece]), a, b, nxt[b], piece))

    offer([(i, i + 1) for i in range(size - 1)])
    alive = [True] * size
    while agenda:
        _, i, j, end, piece = heapq.heappop(agenda)
        if not (alive[i] and alive[j]) or nxt[i] != j or nxt[j] != end:
            continue
        symbol[i], alive[j], nxt[i] = piece, False, end
        if end < size:
            prev[end] = i
        offer([p for p in ((prev[i], i), (i, end)) if p[0] >= 0 and p[1] < size])
    return [x for i in range(size) if alive[i] for x in ([symbol[i]] if symbol[i] >= 0 else vocab.spelled(chunk[i]))]


def segment_short(vocab: Vocabulary, chunks: list[str], keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of one length, all at once: every round merges the best candidate of each row.
    Returns all ids in a row, and their number for each chunk."""
    n, size = len(chunks), len(chunks[0])
    points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = vocab.char_ids[points].astype(np.int64).reshape(n, size)
    nxt = np.tile(np.arange(1, size + 1), (n, 1))
    prev = np.tile(np.arange(-1, size - 1), (n, 1))
    piece = np.full((n, size), -1)
    order = np.full((n, size), NONE)

    def offer(row: np.ndarray, i: np.ndarray) -> None:
        j = nxt[row, i]
        inside = j < size
        order[row[~inside], i[~inside]] = NONE
        row, i, j = row[inside], i[inside], j[inside]
        made = vocab.joined(symbol[row, i], symbol[row, j])
        known = np.flatnonzero(made >= 0)
        value = np.full(len(row), NONE)
        drop = skipped(keys[row[known]], i[known], j[known], nxt[row[known], j[known]], rate)
        value[known] = np.where(drop, NONE, vocab.rank[made[known]])
        order[row, i], piece[row, i] = value, made

    if size > 1:
        offer(np.repeat(np.arange(n), size - 1), np.tile(np.arange(size - 1), n))
        live = np.arange(n)
        while len(live):
            best = order[live].argmin(1)
            some = order[live, best] < NONE
            live, i = live[some], best[some]
            j = nxt[live, i]
            end = nxt[live, j]
            symbol[live, i] = piece[live, i]
            symbol[live, j], order[live, j] = -2, NONE
            nxt[live, i] = end
            inner = end < size
            prev[live[inner], end[inner]] = i[inner]
            before = prev[live, i]
            left = before >= 0
            offer(np.concatenate([live, live[left]]), np.concatenate([i, before[left]]))
    sizes = (symbol != -2).sum(1)
    ids = symbol[symbol != -2]
    if (ids == -1).any():
        ids, sizes = spell_rows(vocab, chunks, symbol, sizes)
    return ids, sizes


def spell_rows(vocab: Vocabulary, chunks: list[str], symbol: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``symbol`` with characters that have no piece spelled in bytes."""
    row, column = np.nonzero(symbol == -1)
    spelled = [vocab.spelled(chunks[r][c]) for r, c in zip(row.tolist(), column.tolist(), strict=True)]
    more = np.array([len(x) for x in spelled])
    width = (symbol != -2).astype(np.int64)
    width[row, column] = more
    at = (np.cumsum(width) - width.ravel()).reshape(width.shape)
    ids = np.zeros(int(width.sum()), np.int64)
    plain = symbol >= 0
    ids[at[plain]] = symbol[plain]
    ids[np.repeat(at[row, column] - (np.cumsum(more) - more), more) + np.arange(int(more.sum()))] = np.concatenate(spelled)
    return ids, width.sum(1)


def segment(vocab: Vocabulary, chunks: list[str], keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all chunks in some order, and where each chunk's begin and how many they are."""
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    first, sizes = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
    parts, base = [], 0
    for size in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == size)
        mine = [chunks[p] for p in places.tolist()]
        if size <= SHORT:
            ids, own = segment_short(vocab, mine, keys[places], rate)
        else:
            found = [segment_long(vocab, c, int(k), rate) for c, k in zip(mine, keys[places], strict=True)]
            own = np.array([len(f) for f in found], np.int64)
            ids = np.concatenate(found).astype(np.int64)
        first[places], sizes[places] = base + np.cumsum(own) - own, own
        parts.append(ids)
        base += len(ids)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), first, sizes


def skip_sets(vocab: Vocabulary, words: list[str], number: np.ndarray, keys: np.ndarray, rate: float) -> np.ndarray:
    """A hash of the candidates each occurrence skips; ``number`` is its word. Occurrences of a word
    with equal hashes have equal pieces. Words longer than SHORT or rarer than OFTEN get their keys."""
    alone = (np.bincount(number, minlength=len(words)) < OFTEN) | np.array([len(w) > SHORT for w in words], bool)
    none = np.zeros((3, 0), np.uint8)
    tables = [none if single else vocab.candidates(w) for w, single in zip(words, alone.tolist(), strict=True)]
    sizes = np.array([t.shape[1] for t in tables], np.int64)
    begins = np.cumsum(sizes) - sizes
    borders = np.concatenate([none, *tables], axis=1)
    out = np.zeros(len(number), np.uint64)
    draws = sizes[number]
    ends = np.cumsum(draws)
    low = 0
    while low < len(number):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - draws[low] + DRAWS, side="right")))
        mine = draws[low:high]
        row = np.repeat(np.arange(low, high), mine)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(mine) - mine, mine)
        at = begins[number[row]] + turn
        gone = np.flatnonzero(skipped(keys[row], *borders[:, at], rate))
        np.add.at(out, row[gone], mix((turn[gone] + 1).astype(np.uint64)))
        low = high
    return np.where(alone[number], keys, out) if len(number) else out


class Places(dict):
    def __missing__(self, chunk: str) -> int:
        at = self[chunk] = len(self)
        return at


def encode_texts(vocab: Vocabulary, texts: list[bytes], names: list[str], seed: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """All ids of ``texts`` in a row, and the number of each text."""
    place = Places()
    number: list[int] = []
    counts, starts = [], []
    for text, name in zip(texts, names, strict=True):
        chunks = ()
        if text:
            marked = text.decode().replace(MARK, LITERAL).replace(" ", MARK)
            chunks = CHUNK.findall(MARK + marked)
        number.extend(map(place.__getitem__, chunks))
        counts.append(len(chunks))
        starts.append(xxhash.xxh64_intdigest(name.encode(), seed))
    number, counts = np.array(number, np.int64), np.array(counts, np.int64)
    total = int(counts.sum())
    at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    keys, skips = np.zeros(total, np.uint64), np.zeros(total, np.uint64)
    words = list(place)
    if rate > 0:
        keys = mix(np.repeat(np.array(starts, np.uint64), counts) + mix(at.astype(np.uint64)))
        skips = skip_sets(vocab, words, number, keys, rate)
    order = np.lexsort((skips, number))
    fresh = np.ones(total, bool)
    fresh[1:] = (np.diff(number[order]) != 0) | (skips[order][1:] != skips[order][:-1])
    back = np.empty(total, np.int64)
    back[order] = np.cumsum(fresh) - 1
    wanted = order[fresh]
    flat, first, sizes = segment(vocab, [words[i] for i in number[wanted].tolist()], keys[wanted], rate)
    own = sizes[back] if total else np.zeros(0, np.int64)
    ends = np.cumsum(own)
    ids = flat[np.repeat(first[back] - (ends - own), own) + np.arange(int(own.sum()))] if total else flat
    borders_of = np.concatenate([[0], np.cumsum(counts)])
    return ids, np.diff(np.concatenate([[0], ends])[borders_of])


def decode_ids(vocab: Spellings, ids: list[int]) -> bytes:
    return b"".join(map(vocab.bytes_of.__getitem__, ids))[1:]


def decode_lists(vocab: Spellings, lists: pa.ListArray) -> list[bytes]:
    """The texts of many id lists: one gather of spellings, cut where the lists end."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = vocab.spelling.take(lists.flatten())
    if not len(spelled):
        return [b""] * len(lists)
    at = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset:spelled.offset + len(spelled) + 1]
    ends = np.cumsum(sizes)
    whole = memoryview(spelled.buffers()[2])
    return [bytes(whole[a + 1:b]) for a, b in zip(at[ends - sizes].tolist(), at[ends].tolist(), strict=True)]


def send_model(docs: DataFrame, path: str):
    with open(path, "rb") as file:
        model = file.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"the vocabulary is larger than {MODEL_BYTES} bytes")
    return docs.sparkSession.sparkContext.broadcast(model)


def encode(docs: DataFrame, path: str = VOCABULARY, seed: int = SEED, rate: float = DROPOUT, output: str = "tokens") -> DataFrame:
    """``docs`` plus ``output``, the ids of each text."""
    sent = send_model(docs, path)
    others = [c for c in docs.columns if c != "text" and c != output]
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select("text", name.alias("name"), F.struct(F.lit(0).alias("_"), *others).alias("doc"))

    def scan(batches):
        vocab = vocabulary(sent.value)
        for part, texts in text_slices(batches, "text", SLICE):
            ids, sizes = encode_texts(vocab, texts, part.column("name").to_pylist(), seed, rate)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("text"), part.column("doc"),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], names=["text", "doc", "tokens"])

    done = map_arrow(rows, scan, f"text string, doc {rows.schema['doc'].dataType.simpleString()}, tokens array<int>")
    columns = [F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns if c != output]
    return done.select(*columns, F.col("tokens").alias(output))


def decode(docs: DataFrame, path: str = VOCABULARY, tokens: str = "tokens", output: str = "decoded") -> DataFrame:
    """``docs`` plus ``output``, the text of the ids in ``tokens`` (null: none)."""
    sent = send_model(docs, path)
    others = [c for c in docs.columns if c != output]
    rows = docs.select(F.col(tokens).alias("ids"), F.struct(*others).alias("doc"))

    def scan(batches):
        vocab = spellings(sent.value)
        for part in batches:
            lists = part.column("ids")
            for start in range(0, part.num_rows, 200):
                texts = decode_lists(vocab, lists.slice(start, 200))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").slice(start, 200), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc", "decoded"])

    done = map_arrow(rows, scan, f"doc {rows.schema['doc'].dataType.simpleString()}, decoded string")
    return done.select(*[F.col(f"doc.`{c}`") for c in others], F.col("decoded").alias(output))


def report(docs: DataFrame) -> DataFrame:
    """Per document: its ids, their number, the digest of the decoded text, and whether it is the text."""
    done = decode(encode(docs.select("doc_id", "text")))
    return done.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens",
                       F.sha2("decoded", 256).alias("decoded_sha256"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))

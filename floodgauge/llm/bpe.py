"""Byte-level BPE over overlapping chunks, and its inverse.

A text longer than a chunk is cut into chunks that overlap. Chunks are pre-tokenised in parallel, each from its own first character. The matches of
a pattern that runs from left to right depend on what follows only, so as soon as two neighbours have a boundary in common
inside their overlap, they agree from there on: that is where they are stitched. Where they never agree (a run without any
boundary), the chunks are joined and matched anew. The stitched pieces, each with its boundaries, are then encoded in parallel, match by match.
Texts of one chunk need no stitching and are never shuffled. Decoding concatenates the bytes of the ids.

The vocabulary's file of ranks is a parameter; its bytes are broadcast (it is fixed in size, about 1 MB).

Edge cases: a null or empty text has no ids and decodes to nothing. Control strings in a text are ordinary text. Repeated rows come back one by one.
An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgauge.llm.common import query, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 32_768, 1_024
#: Pieces whose ids a worker remembers.
REMEMBERED = 120_000
ENCODED = "key bigint, id {id}, part int, ids array<int>"

_MATCH = regex.compile(public_tokenizers.PATTERN)


class Vocabulary:
    def __init__(self, file: bytes):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.encoding = tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def ids(self, pieces: Iterable[str]) -> np.ndarray:
        """Ids of matches, each encoded by itself; a match that was met before costs one look-up."""
        known, out = self.known, []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.encoding.encode_ordinary(piece), np.int32).tobytes()
                if len(piece) < 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    """One list of ids for each row."""
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), np.concatenate([*rows, np.zeros(0, np.int32)]))


@lru_cache(maxsize=2)
def _vocabulary(file: bytes) -> Vocabulary:
    return Vocabulary(file)


def _shared(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def pieces(text: str) -> list[str]:
    return _MATCH.findall(text)


def ends(text: str) -> list[int]:
    return [m.end() for m in _MATCH.finditer(text)]


def chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, bool, str]]:
    """Number, whether it is the last, and text of each chunk."""
    count = max(1, -(-len(text) // size))
    for k in range(count):
        yield k, k == count - 1, text[k * size : (k + 1) * size + overlap]


def stitched(parts: Iterable[tuple[int, bool, str, list[int]]], size: int) -> Iterator[tuple[str, list[int]]]:
    """Stretches of one text with the ends of their matches, from its chunks in order with the ends that each found by itself."""
    base, text, found, true_from, more = 0, "", [], 0, ""

    def stretch(lo: int, hi: int):
        """From one true boundary to another, both relative to ``base``."""
        return text[lo:hi], [e - lo for e in found if lo < e <= hi]

    for k, last, chunk, own in parts:
        at = k * size
        if k == 0:
            text, found = chunk, own
            continue
        sync = None
        if not more:
            mine = {0, *own} - ({len(chunk)} if not last else set())
            seen = [e for e in [true_from, *found] if e < len(text)]
            sync = next((e for e in seen if e >= true_from and e + base >= at and e + base - at in mine), None)
        if sync is not None:
            if sync > true_from:
                yield stretch(true_from, sync)
            base, true_from, text, found = at, sync + base - at, chunk, own
            continue
        # No common boundary: what is not settled yet goes on with this chunk's further text, matched anew once it has doubled.
        end = base + len(text) + len(more)
        more += chunk[end - at :]
        if last or len(more) >= len(text) - true_from:
            settled = max((e for e in found if true_from < e < len(text)), default=true_from)
            if settled > true_from:
                yield stretch(true_from, settled)
            base, text, more = base + settled, text[settled:] + more, ""
            true_from, found = 0, ends(text)
    if true_from < len(text):
        yield stretch(true_from, len(text))


def _rows(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))


def _short(rows: DataFrame, shared, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            for part in (batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)):
                ids = _lists([vocabulary.ids(pieces(t.as_py())) for t in part.column("text")])
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), part.column("id"), pa.array([0] * n, pa.int32()), ids], ["key", "id", "part", "ids"])

    return rows.where(F.length("text") <= size).mapInArrow(run, ENCODED.format(id=rows.schema["id"].dataType.simpleString()))


def _long(rows: DataFrame, shared, size: int, overlap: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for key, name, text in zip(*(batch.column(c) for c in ("key", "id", "text"))):
                for k, last, chunk in chunks(text.as_py(), size, overlap):
                    yield pa.RecordBatch.from_pylist([{"key": key.as_py(), "id": name.as_py(), "k": k, "last": last, "chunk": chunk}], schema=cut_schema)

    def match(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([ends(t.as_py()) for t in batch.column("chunk")], pa.list_(pa.int32()))], [*batch.schema.names, "ends"])

    def stitch(batches: Iterator[pa.RecordBatch]):
        rows_in_order = ((key.as_py(), name.as_py(), k.as_py(), last.as_py(), chunk.as_py(), own.as_py()) for b in batches for key, name, k, last, chunk, own in zip(*b.columns))
        for (key, name), of in itertools.groupby(rows_in_order, key=lambda r: r[:2]):
            for number, (text, own) in enumerate(stitched((r[2:] for r in of), size)):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([name], id_type), pa.array([number], pa.int32()), pa.array([text], pa.string()), pa.array([own], pa.list_(pa.int32()))], ["key", "id", "part", "text", "ends"])

    def encode(batches: Iterator[pa.RecordBatch]):
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text"), batch.column("ends")):
                text, own = text.as_py(), own.as_py()
                out.append(vocabulary.ids(text[a:b] for a, b in zip([0, *own], own)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(out)], ["key", "id", "part", "ids"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)
    cut_schema = pa.schema([("key", pa.int64()), ("id", id_type), ("k", pa.int32()), ("last", pa.bool_()), ("chunk", pa.string())])
    cuts = f"key bigint, id {kind}, k int, last boolean, chunk string"
    numbered = rows.where(F.length("text") > size).select(F.monotonically_increasing_id().alias("key"), "id", "text")
    matched = numbered.mapInArrow(cut, cuts).repartition("key", "k").mapInArrow(match, f"{cuts}, ends array<int>")
    whole = matched.repartition("key").sortWithinPartitions("key", "k").mapInArrow(stitch, f"key bigint, id {kind}, part int, text string, ends array<int>")
    return whole.repartition("key", "part").mapInArrow(encode, ENCODED.format(id=kind))


def encoded(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranks: str = RANKS, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key, id, part, ids``: one row per text of one chunk (key null), one per stretch of a longer text (same key, parts in order)."""
    rows, shared = _rows(documents, id_column, text_column), _shared(documents.sparkSession, ranks)
    return _short(rows, shared, size).unionAll(_long(rows, shared, size, overlap))


def _digests(rows: DataFrame, shared) -> DataFrame:
    """Numbers and digests of each text; its rows follow one another. Only one text's digest state is held at a time."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        vocabulary = _vocabulary(shared.value)
        decimal, raw = [str(i) for i in range(len(vocabulary.bytes_of))].__getitem__, vocabulary.bytes_of.__getitem__
        state, out = None, []

        def flush():
            nonlocal out
            columns = list(zip(*[(name, n, a.hexdigest(), b.hexdigest()) for _, name, n, a, b in out]))
            out = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            for key, name, ids in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), batch.column("ids")):
                ids = ids.values.to_numpy().tolist() if ids.is_valid else []
                if state is None or key is None or key != state[0]:
                    if state:
                        out.append(state)
                    state = [key, name, 0, hashlib.sha256(), hashlib.sha256()]
                if ids:
                    state[3].update(((" " if state[2] else "") + " ".join(map(decimal, ids))).encode())
                    state[4].update(b"".join(map(raw, ids)))
                    state[2] += len(ids)
                if len(out) >= 1000:
                    yield flush()
        if state:
            out.append(state)
        if out:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def digests(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranks: str = RANKS, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, read from its ids."""
    rows, shared = _rows(documents, id_column, text_column), _shared(documents.sparkSession, ranks)
    in_order = _long(rows, shared, size, overlap).repartition("key").sortWithinPartitions("key", "part")
    return _digests(_short(rows, shared, size), shared).unionAll(_digests(in_order, shared))


def decoded(ids: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The rows of ``encoded`` with ``bytes``: what the ids of each stand for; a text is the concatenation of its parts."""
    shared = _shared(ids.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]):
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            raw = [vocabulary.decode(i.as_py() or ()) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], ["key", "id", "part", "bytes"])

    return ids.mapInArrow(run, f"key bigint, id {ids.schema['id'].dataType.simpleString()}, part int, bytes binary")


@query("op9_byte_bpe")
def op9_byte_bpe(spark, folder):
    """Encoded and decoded digests of every whole document."""
    return digests(table(spark, folder, "documents"))

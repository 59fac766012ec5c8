"""Packing by concatenate and cut.

Pass one tokenizes every document once and notes each partition's token total. Prefix sums over those totals, with the running
sums inside partitions, give every document its global offset. Pass two cuts the one long stream at multiples of the window;
a document that crosses a cut gives one piece on each side (the boundary records).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, stored, tidy

#: What follows each document.
END_ID = 1


class Encoder:
    """Ids as the tokenizer file gives them, without added special tokens; a special token's string in a text is that token.

    Texts of Latin letters and below without such a string go through the same vocabulary in its faster library; all others, where
    the two could class a character differently, through the tokenizer itself. spec and ranks hold one vocabulary.
    """

    FAR = re.compile("[^\x00-ɏ]")

    def __init__(self, spec: str, ranks: bytes | None = None, pattern: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(spec)
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})

    def __call__(self, text: str):
        import numpy as np

        if self.fast is not None and not self.FAR.search(text) and not any(x in text for x in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.asarray(self.own.encode(text, add_special_tokens=False).ids, np.uint32)


def tokenizer_files(name: str = "byte_bpe_50k") -> tuple[str, bytes, str]:
    """The tokenizer's file, the same vocabulary as ranks, and its split pattern, read on the driver: a few MB at most."""
    import public_tokenizers as files

    with open(files.path(f"{name}.json"), encoding="utf-8") as f, open(files.path(f"{name}.tiktoken"), "rb") as g:
        return f.read(), g.read(), files.PATTERN


def tokenized(docs: DataFrame, files: tuple[str, bytes, str], end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (little-endian, 4 bytes each), n, part, before: stored once, so that no later step tokenizes again."""
    t = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = t.sparkSession.sparkContext.broadcast(files)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part, before = Encoder(*shared.value), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids, counts, starts = [], [], []
            for text in batch.column("text").to_pylist():
                a = np.append(encode(text), end_id)
                ids.append(a.astype("<u4").tobytes())
                counts.append(len(a))
                starts.append(before)
                before += len(a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64())], ["doc_id", "ids", "n", "part", "before"])

    return stored(t.mapInArrow(tidy(run), "doc_id long, ids binary, n long, part long, before long"), "pack-ids")


def pack(docs: DataFrame, files: tuple[str, bytes, str] | None = None, window: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids with keep_ids), in every case of every row.

    All sequences are full but the last. Null and empty texts give one piece that holds the end id alone. Ids that are null or
    repeat are carried along; each row is a document of its own. Very long texts give as many pieces as they need. Other columns are
    not read, whatever their names. An empty table gives no piece. The driver sees one total for
    each partition, nothing that grows with rows.
    """
    rows = tokenized(docs, files or tokenizer_files())
    totals = sorted((r.part, r.t) for r in rows.groupBy("part").agg(F.sum("n").alias("t")).collect())
    offsets, at = {}, 0
    for part, total in totals:
        offsets[part] = at
        at += total

    def cut(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in slices(batches, "ids"):
            out = [[] for _ in range(8)]
            for doc, ids, n, part, before in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "n", "part", "before")), strict=True):
                first = offsets[part] + before
                begin = 0
                while begin < n:
                    seq, off = divmod(first + begin, window)
                    length = min(n - begin, window - off)
                    piece = ids[4 * begin : 4 * (begin + length)]
                    for column, v in zip(out, (doc, begin, length, zlib.crc32(piece), n, seq, off, piece), strict=True):
                        column.append(v)
                    begin += length
            arrays = [pa.array(c, pa.int64()) for c in out[:7]]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out[7]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * keep_ids)

    return rows.mapInArrow(tidy(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids, docs: each packed sequence whole, from pieces with ids. A sequence has at most `window` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("docs"))

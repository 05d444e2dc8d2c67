"""Lines repeated across the documents of one site.

Every line has a key: lower case, letters only, hashed to 128 bits together
with its site and table.  The documents of a key are held as compressed
bitmaps: ids are cut into ranges of 65,536 (containers), a container is a
sorted array of 16-bit offsets while it is small and a plain bitmap of 8 KB
beyond.  Bitmaps are built in the chunks where lines are read; those of the
variants of a line, in whatever spelling and chunk, are united per container
and stored, and the exact cardinalities of a key's containers add up.  The
containers of keys with enough documents are kept, and a line is deleted if
its document's bit is set in one of them.  Lines and bitmaps meet by (line,
container), so that a task holds at most 65,536 documents of a line however
many the site has.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.balanced import chunks
from quarrymill.session import stored

MIN_DOCS = 6
CHUNK_LINES = 300_000
#: Offsets beyond which a bitmap is smaller than the array.
ARRAY_MAX = 4096
#: Offsets of a kept container that are looked up one by one; beyond, by the bit in a word of 64.
LISTED_MAX = 256


def line_keys(text: Column) -> Column:
    """What each line of a text agrees in with equal lines: lower case, letters of any script only."""
    return F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\n]+", ""), "\n", -1)


def keyed_lines(docs: DataFrame, id_col: str, site_col: str, text_col: str) -> DataFrame:
    """(id, line_no, k1, k2) of the lines that have letters; one row per line.
    Documents with a null id, site or text have no lines."""
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(site_col).cast("string").alias("site"), F.col(text_col).cast("string").alias("text"))
    d = d.where(F.col("id").isNotNull() & F.col("site").isNotNull() & F.col("text").isNotNull())
    lines = d.select("id", "site", F.posexplode(line_keys(F.col("text"))).alias("pos", "key")).where("key <> ''").withColumn("line_no", F.col("pos") + 1)
    # two independent 64-bit hashes: equal keys of different lines don't happen
    return lines.select("id", "line_no", F.xxhash64("site", "key").alias("k1"), F.xxhash64(F.lit("second"), "key", "site").alias("k2"))


def pack(low) -> bytes:
    """A container of sorted distinct 16-bit offsets."""
    import numpy as np

    if len(low) <= ARRAY_MAX:
        return low.astype("<u2").tobytes()
    bits = np.zeros(65536, dtype="uint8")
    bits[low] = 1
    return b"\x01" + np.packbits(bits).tobytes()  # odd length marks a bitmap


def unpack(data: bytes):
    import numpy as np

    if len(data) % 2:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, "uint8", offset=1))).astype("int64")
    return np.frombuffer(data, "<u2").astype("int64")


def _groups(arrays) -> list:
    """Starts of runs of equal rows in sorted arrays."""
    import numpy as np

    n = len(arrays[0])
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for a in arrays:
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def _build(batches: Iterator) -> Iterator:
    """Bitmaps of a chunk's lines: (k1, k2, high, bits)."""
    import numpy as np
    import pyarrow as pa

    for t in chunks(batches, CHUNK_LINES):
        k1, k2, ids = (t[c].to_numpy() for c in ("k1", "k2", "id"))
        order = np.lexsort((ids, k2, k1))
        k1, k2, ids = k1[order], k2[order], ids[order]
        once = _groups([k1, k2, ids])
        k1, k2, ids = k1[once], k2[once], ids[once]
        high, low = ids >> 16, (ids & 0xFFFF).astype("<u2")
        starts = _groups([k1, k2, high])
        sizes = np.diff(np.r_[starts, len(ids)])
        if (sizes > ARRAY_MAX).any():
            ends = np.r_[starts[1:], len(ids)]
            bits = pa.array([pack(low[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary())
        else:  # all are arrays: their bytes already lie one after the other
            at = pa.py_buffer(np.r_[starts, len(ids)].astype("int32") * 2)
            bits = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, at, pa.py_buffer(low.tobytes())])
        out = pa.table({"k1": k1[starts], "k2": k2[starts], "high": high[starts], "bits": bits})
        yield from out.to_batches(max_chunksize=50_000)


def _unite(batches: Iterator) -> Iterator:
    """(k1, k2, high, bits, docs): the union of the bitmaps of each (k1, k2,
    high), which come one after the other, and its exact cardinality."""
    import numpy as np
    import pyarrow as pa

    names = ["k1", "k2", "high", "bits", "docs"]

    def out(rows):
        keys = [pa.array(x, pa.int64()) for x in zip(*(key for key, _ in rows), strict=True)]
        return pa.RecordBatch.from_arrays([*keys, pa.array([pack(ids) for _, ids in rows], pa.binary()), pa.array([len(ids) for _, ids in rows], pa.int64())], names=names)

    last, held = None, None
    for b in batches:
        if not b.num_rows:
            continue
        k1, k2, high = (b[c].to_numpy() for c in ("k1", "k2", "high"))
        starts = _groups([k1, k2, high])
        ends = np.r_[starts[1:], len(k1)]
        lengths = np.diff(np.frombuffer(b["bits"].buffers()[1], "int32", count=len(k1) + 1, offset=4 * b["bits"].offset))
        # containers of one part, which is an array, pass as they are; the last of a batch may go on
        plain = (ends - starts == 1) & (lengths[starts] % 2 == 0) & (ends < len(k1))
        plain[0] &= last != (int(k1[0]), int(k2[0]), int(high[0]))
        done = []
        for a, e in zip(starts[~plain].tolist(), ends[~plain].tolist(), strict=True):
            key = (int(k1[a]), int(k2[a]), int(high[a]))
            union = np.unique(np.concatenate([unpack(x) for x in b["bits"].slice(a, e - a).to_pylist()]))
            if key == last:
                held = np.union1d(held, union)
            else:
                if last is not None:
                    done.append((last, held))
                last, held = key, union
        if done:
            yield out(done)
        if plain.any():
            at = pa.array(starts[plain])
            yield pa.RecordBatch.from_arrays([*(b[c].take(at) for c in ("k1", "k2", "high", "bits")), pa.array(lengths[starts[plain]].astype("int64") // 2)], names=names)
    if last is not None:
        yield out([(last, held)])


def _readable(batches: Iterator) -> Iterator:
    """Containers as columns that expressions can look into: ``listed``
    offsets of a small one, or 1,024 ``words`` of 64 bits."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        listed, words = [], []
        for x in b["bits"].to_pylist():
            low = unpack(x)
            small = len(low) <= LISTED_MAX
            listed.append(low.astype("int32") if small else None)
            if not small:
                bits = np.zeros(65536, dtype="uint8")
                bits[low] = 1
            words.append(None if small else np.packbits(bits, bitorder="little").view("<i8"))
        yield pa.RecordBatch.from_arrays([*(b[c] for c in ("k1", "k2", "high", "total")), pa.array(listed, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int64()))], names=["k1", "k2", "high", "docs", "listed", "words"])


def repeated_containers(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k1, k2, high, docs, listed, words): the containers of the keys found in
    at least ``min_docs`` documents; ``docs`` is the key's number of them."""
    maps = lines.select("k1", "k2", "id").mapInArrow(_build, "k1 bigint, k2 bigint, high bigint, bits binary")
    # one container is at most 8 KB, so no key's state outgrows a task; a key's containers lie apart
    met = maps.repartition("k1", "k2", "high").sortWithinPartitions("k1", "k2", "high")
    united = stored(met.mapInArrow(_unite, "k1 bigint, k2 bigint, high bigint, bits binary, docs bigint"), "bitmaps")
    counts = united.groupBy("k1", "k2").agg(F.sum("docs").alias("total")).where(F.col("total") >= min_docs)
    kept = united.join(counts, ["k1", "k2"]).select("k1", "k2", "high", "bits", "total")
    return kept.mapInArrow(_readable, "k1 bigint, k2 bigint, high bigint, docs bigint, listed array<int>, words array<bigint>")


def repeated_lines(docs: DataFrame, id_col: str = "id", site_col: str = "site", text_col: str = "body_text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, line_no, docs): the lines found in at least ``min_docs`` distinct
    ids of their site, with that number; line n is the n-th part of the text
    split at "\\n", counted from 1.

    Defined cases: rows with a null id, site or text, and lines without
    letters, are no lines; a document delivered again, or a line that stands
    twice in a document, counts once; an empty table gives no rows; texts are
    taken whole; further columns are ignored.
    """
    lines = keyed_lines(docs, id_col, site_col, text_col).withColumn("high", F.shiftright("id", 16))
    low = F.col("id").bitwiseAND(F.lit(0xFFFF)).cast("int")
    word = F.get("words", F.shiftright(low, 6))
    is_set = F.when(F.col("listed").isNotNull(), F.array_contains("listed", low)).otherwise(F.getbit(word, F.pmod(low, F.lit(64))) == 1)
    met = lines.join(repeated_containers(lines, min_docs), ["k1", "k2", "high"]).where(is_set)
    return met.select("k1", "k2", "high", "id", "line_no", "docs").distinct().select("id", "line_no", "docs")


def without_lines(docs: DataFrame, cut: DataFrame, id_col: str = "id", text_col: str = "body_text", out: str = "clean_text") -> DataFrame:
    """``docs`` with the column ``out``: the text without the lines of ``cut``
    (id, line_no).  Documents without such lines keep their text; null stays
    null.  A column ``out`` that the input has already is replaced."""
    gone = cut.groupBy(F.col("id").alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.join(gone, F.col(id_col) == F.col("__id"), "left").withColumn("__parts", F.when(F.col("__gone").isNotNull(), F.split(F.col(text_col), "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(1), F.size("__parts")), F.col("__gone"))  # by hashes, in order
    clean = F.array_join(F.transform(kept, lambda n: F.get("__parts", n - 1)), "\n")
    return joined.withColumn(out, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(clean)).drop("__id", "__gone", "__parts")


def found(spark, sf_dir: str, table) -> DataFrame:
    """p3_found: (record_table, record_id, line_no)."""
    parts = [("indexable_documents", "body_text"), ("search_documents", "excerpt")]
    rows = [repeated_lines(table(spark, sf_dir, t), text_col=c).select(F.lit(t).alias("record_table"), F.col("id").alias("record_id"), F.col("line_no").cast("int").alias("line_no")) for t, c in parts]
    return rows[0].unionByName(rows[1])

"""Evaluation passages inside training documents.

Word windows are embedded by the CGK random walk: 3 * WINDOW steps read the
current word, write it, and move on or stay by a random bit of the word, so a
few edits between two windows leave a small Hamming distance between their
embeddings.  Bit-sampling LSH over the embeddings is repeated in as many
tables as a target recall asks for.  Equal keys of item windows and document
windows give candidate alignments in one pass over the documents, however many
items there are.  Each is then verified exactly, by
the longest run of equal words on its diagonal and by the edit distance of
windows as long as the item, up to PASSAGE words.

Two windows of equal words always collide.  Item windows start at every word
and document windows at every STRIDE-th, with WINDOW + STRIDE - 1 = MIN_RUN,
so a shared run of MIN_RUN words holds an aligned window and is never missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import stored

MIN_RUN = 12
WINDOW, STRIDE = 8, 5
STEPS = 3 * WINDOW
#: Positions of the embedding that each table samples, and the part of windows with one word replaced that must collide in some table.
SAMPLED, WINDOW_RECALL = 8, 0.5
#: Most words compared by edit distance around an alignment, and the most edits in so many; shorter items in proportion.
PASSAGE, MAX_EDITS = 24, 6
#: Bits of the sketch of item keys that is sent to the executors: at most 16 MB, whatever the items.
LEAST_BITS, MOST_BITS = 16, 27
#: Words of items that may be sent with their windows (about 30 MB); beyond, windows meet by a join.
SENT_WORDS = 500_000
#: Words of documents verified at once.
VERIFY_WORDS = 1_000_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Longest runs of letters and digits of any script, lower-cased."""
    return WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    """Word -> 64-bit hash, never 0."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = (xxhash.xxh3_64_intdigest(word) | 1) - (1 << 63)
        return h


def embed_keys(windows, samples: tuple[tuple[int, ...], ...] | None = None):
    """Sampled keys of the CGK embeddings of windows of word hashes (n x WINDOW), one array per table."""
    import numpy as np

    samples = sampled_positions() if samples is None else samples
    n = len(windows)
    padded = np.zeros((n, WINDOW + 1), dtype="int64")
    padded[:, :WINDOW] = windows
    flat, base, at = padded.ravel(), np.arange(n, dtype="int64") * (WINDOW + 1), np.zeros(n, dtype="int64")
    keys = [np.full(n, t + 1, dtype="uint64") for t in range(len(samples))]
    for step in range(STEPS):
        symbol = flat[base + at]
        for key, sample in zip(keys, samples, strict=True):
            if step in sample:
                key *= np.uint64(0x9E3779B97F4A7C15)
                key ^= symbol.view("uint64")
                key ^= key >> np.uint64(29)
        at += (symbol >> (step + 8)) & 1
        np.minimum(at, WINDOW, out=at)
    return keys


@cache
def sampled_positions(recall: float = WINDOW_RECALL) -> tuple[tuple[int, ...], ...]:
    """Positions of each table: tables are added until so large a part of
    simulated windows with one word replaced collides in some table."""
    import numpy as np

    rng = np.random.default_rng(20240117)
    windows = rng.integers(1, 1 << 62, (4000, WINDOW))
    edited = windows.copy()
    edited[np.arange(len(edited)), rng.integers(0, WINDOW, len(edited))] = rng.integers(1, 1 << 62, len(edited))
    samples, missed = [], np.ones(len(windows), dtype=bool)
    while missed.mean() > 1 - recall:
        samples.append(tuple(sorted(rng.permutation(STEPS)[:SAMPLED].tolist())))
        x, y = (embed_keys(w, (samples[-1],))[0] for w in (windows, edited))
        missed &= x != y
    return tuple(samples)


def edit_distance(x, y):
    """Word edit distances of the rows of two arrays, of all rows at once for each pair of places."""
    import numpy as np

    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    kind = "uint8" if len(x) + len(y) < 255 else "int64"
    row = np.repeat(np.arange(len(y) + 1, dtype=kind)[:, None], x.shape[1], axis=1)
    for i, word in enumerate(x):
        before = row[0].copy()
        row[0] = i + 1
        for j in range(1, len(y) + 1):
            best = before + (word != y[j - 1])
            before = row[j].copy()
            np.minimum(best, before + 1, out=best, casting="unsafe")
            np.minimum(best, row[j - 1] + 1, out=row[j], casting="unsafe")
    return row[-1].astype("int64")


def word_hashes(texts: list[str | None], hashes: _Hashes):
    """Hashes of the words of texts one after the other, and how many each has."""
    import numpy as np

    parts = [np.fromiter(map(hashes.__getitem__, w), "int64", len(w)) for w in map(words_of, texts)]
    return (np.concatenate(parts) if parts else np.zeros(0, "int64")), np.array([len(p) for p in parts], dtype="int64")


def places(sizes, stride: int):
    """(text, place) of the windows of texts of ``sizes`` words; none of texts of fewer than MIN_RUN."""
    import numpy as np

    count = np.where(sizes < MIN_RUN, 0, (sizes - WINDOW) // stride + 1)
    text = np.repeat(np.arange(len(sizes)), count)
    return text, stride * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))


def _lists(values, sizes):
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype("int32")), pa.array(values))


def _hashed_items(batches: Iterator) -> Iterator:
    import pyarrow as pa

    hashes = _Hashes()
    for b in batches:
        flat, sizes = word_hashes(b["text"].to_pylist(), hashes)
        t = pa.RecordBatch.from_arrays([b["item_id"], _lists(flat, sizes)], names=["item_id", "item_words"])
        yield t.filter(pa.array(sizes >= MIN_RUN))


def _item_windows(batches: Iterator) -> Iterator:
    """(key, table, item, j) of every window in every table."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        lists = b["item_words"]
        flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
        text, at = places(sizes, 1)
        if not len(at):
            continue
        begin = (np.cumsum(sizes) - sizes)[text] + at
        item = b["item"].to_numpy()[text]
        for part in np.array_split(np.arange(len(at)), -(-len(at) // 100_000)):
            for k, key in enumerate(embed_keys(flat[begin[part][:, None] + np.arange(WINDOW)])):
                yield pa.RecordBatch.from_arrays([pa.array(key.view("int64")), pa.array([k] * len(part), pa.int32()), pa.array(item[part]), pa.array(at[part].astype("int32"))], names=["key", "table", "item", "j"])


def _hits(sketch, bits: int):
    """One row per document with windows whose keys are in the sketch of item keys."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known, hashes, mask = sketch.value, _Hashes(), (1 << bits) - 1
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                b = whole.slice(first, 1000)
                flat, sizes = word_hashes(b["text"].to_pylist(), hashes)
                text, at = places(sizes, STRIDE)
                if not len(at):
                    continue
                begin = (np.cumsum(sizes) - sizes)[text] + at
                found = []
                for part in np.array_split(np.arange(len(at)), -(-len(at) // 100_000)):
                    for key in embed_keys(flat[begin[part][:, None] + np.arange(WINDOW)]):
                        place = (key & np.uint64(mask)).astype("int64")
                        hit = np.flatnonzero((known[place >> 6] >> (place & 63).astype("uint64")) & np.uint64(1))
                        found.append((part[hit], key[hit].view("int64")))
                window, key = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(window):
                    continue
                order = np.argsort(window, kind="stable")
                window, key = window[order], key[order]
                rows, count = np.unique(text[window], return_counts=True)
                inside = np.concatenate([np.arange(e - n, e) for n, e in zip(sizes[rows], np.cumsum(sizes)[rows], strict=True)])
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(rows)), _lists(flat[inside], sizes[rows]), _lists(at[window].astype("int32"), count), _lists(key, count)], names=["doc_id", "words", "at", "keys"])

    return run


def distinct_rows(*columns):
    """The distinct rows of columns of integers, as columns, and where each row is among them."""
    import math

    import numpy as np

    least = [int(c.min()) for c in columns]
    sizes = [int(c.max()) - low + 1 for c, low in zip(columns, least, strict=True)]
    if math.prod(sizes) >= 1 << 62:
        rows, back = np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True)
        return [*rows.T], back.ravel()
    code = np.zeros(len(columns[0]), dtype="int64")
    for c, low, size in zip(columns, least, sizes, strict=True):
        code = code * size + (c - low)
    code, back = np.unique(code, return_inverse=True)
    out = []
    for low, size in zip(least[::-1], sizes[::-1], strict=True):
        code, rest = np.divmod(code, size)
        out.append(rest + low)
    return out[::-1], back


def longest_runs(words, first, items, second, sizes):
    """Length of the longest run of equal words of each pair of stretches: ``sizes`` words of ``words`` from ``first`` and of ``items`` from ``second``."""
    import numpy as np

    out, at = np.zeros(len(sizes), dtype="int64"), 0
    while at < len(sizes):
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 4_000_000, "right")))
        n = sizes[at:to]
        start = np.cumsum(n) - n
        which, place = np.repeat(np.arange(len(n)), n), np.arange(int(n.sum()))
        inner = place - start[which]
        same = words[first[at:to][which] + inner] == items[second[at:to][which] + inner]
        last = np.maximum.accumulate(np.where(same, -1, place))
        out[at:to] = np.maximum.reduceat(np.where(same, place - np.maximum(last, start[which] - 1), 0), start)
        at = to
    return out


def _checked(docs, items, doc, item, at, j, max_edits: int):
    """Batches of (doc_id, item_id, run, edits) of the pairs with a long run or
    few edits; ``docs`` and ``items``: ids, words one after the other and how
    many each has; ``doc``, ``item``, ``at``, ``j``: candidate alignments."""
    import numpy as np
    import pyarrow as pa

    (doc_ids, words, n), (item_ids, others, m) = docs, items
    d0, i0 = np.cumsum(n) - n, np.cumsum(m) - m
    # the longest run on every diagonal of a pair that holds an alignment
    (d, i, shift), back = distinct_rows(doc, item, at - j)
    from_doc, from_item = np.maximum(shift, 0), np.maximum(-shift, 0)
    run = longest_runs(words, d0[d] + from_doc, others, i0[i] + from_item, np.minimum(n[d] - from_doc, m[i] - from_item))[back]
    # windows of the item's size around the alignment; places outside the document hold no word
    span = np.minimum(PASSAGE, m[item])
    edits = np.where(run >= span, 0, span)
    words, others = np.r_[words, 0], np.r_[others, 0]
    for size in np.unique(span).tolist():
        todo = np.flatnonzero((span == size) & (run < size))
        for part in np.array_split(todo, -(-len(todo) // 20_000)) if len(todo) else ():
            mine, its = doc[part], item[part]
            begin = np.clip(j[part] - (size - WINDOW) // 2, 0, m[its] - size)
            place = (begin + at[part] - j[part])[:, None] + np.arange(size)
            x = words[np.where((place >= 0) & (place < n[mine][:, None]), d0[mine][:, None] + place, len(words) - 1)]
            edits[part] = edit_distance(x, others[(i0[its] + begin)[:, None] + np.arange(size)])
    keep = (run >= MIN_RUN) | (edits * PASSAGE <= max_edits * span)
    t = pa.table({"doc_id": doc_ids[doc[keep]], "item_id": item_ids[item[keep]], "run": run[keep], "edits": edits[keep]})
    t = t.group_by(["doc_id", "item_id"]).aggregate([("run", "max"), ("edits", "min")]).rename_columns(["doc_id", "item_id", "run", "edits"])
    return t.combine_chunks().to_batches()


def _flat(lists):
    return lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False).astype("int64")


def _verify(max_edits: int):
    """(doc_id, item_id, run, edits) of rows that hold a document, an item and their candidate alignments."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for whole in batches:
            ends = np.cumsum(_flat(whole["words"])[1])
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + VERIFY_WORDS, "right")))
                b = whole.slice(at, to - at)
                pairs, k = b["pairs"].flatten(), b["pairs"].value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(k)), k)
                places = (pairs.field(c).to_numpy().astype("int64") for c in ("at", "j"))
                yield from _checked((b["doc_id"].to_numpy(), *_flat(b["words"])), (b["item_id"].to_numpy(), *_flat(b["item_words"])), row, row, *places, max_edits)
                at = to

    return run


def _search(sent, max_edits: int):
    """(doc_id, item_id, run, edits) of documents, against the windows and words of all items."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        tables, items = sent.value
        hashes = _Hashes()
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                b = whole.slice(first, 1000)
                flat, sizes = word_hashes(b["text"].to_pylist(), hashes)
                text, at = places(sizes, STRIDE)
                begin = (np.cumsum(sizes) - sizes)[text] + at
                found = []
                for part in np.array_split(np.arange(len(at)), -(-len(at) // 100_000)) if len(at) else ():
                    for key, (known, item, j) in zip(embed_keys(flat[begin[part][:, None] + np.arange(WINDOW)]), tables, strict=True):
                        key = key.view("int64")
                        lo = np.searchsorted(known, key, "left")
                        hit = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == key) if len(known) else np.zeros(0, "int64")
                        lo, n = lo[hit], np.searchsorted(known, key[hit], "right") - lo[hit]
                        inner = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        found.append((np.repeat(text[part[hit]], n), item[inner], np.repeat(at[part[hit]], n), j[inner]))
                if sum(len(x[0]) for x in found):
                    pairs, _ = distinct_rows(*map(np.concatenate, zip(*found, strict=True)))
                    yield from _checked((b["doc_id"].to_numpy(), flat, sizes), items, *pairs, max_edits)

    return run


def leaked_items(documents: DataFrame, items: DataFrame, max_edits: int = MAX_EDITS, sent_words: int = SENT_WORDS) -> DataFrame:
    """(doc_id, item_id, run, edits): the documents that hold a passage of an
    item, as a run of at least MIN_RUN equal words (always found) or as a
    window as long as the item, of PASSAGE words at most, with at most
    ``max_edits`` word edits in PASSAGE (found with the LSH's recall).  ``run``
    is the longest run through a found alignment, ``edits`` the fewest edits of
    a compared window.

    The documents are read once.  Items of up to ``sent_words`` words are sent
    to the executors with their windows; of more, a sketch of their keys, of
    bounded size, is sent, the windows that it lets through meet the items by a
    join on keys, and only documents with such windows go on.  The result is
    the same.

    Defined cases: null ids and null texts have no passages; texts and items of
    fewer than MIN_RUN words are too short; repeated rows give one row per
    pair; empty tables give no rows; texts are searched whole; further columns
    are ignored.
    """
    known = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    known = stored(known.mapInArrow(_hashed_items, "item_id bigint, item_words array<bigint>").withColumn("item", F.monotonically_increasing_id()), "items")
    windows = known.select("item", "item_words").mapInArrow(_item_windows, "key bigint, table int, item bigint, j int")
    total = known.agg(F.coalesce(F.sum(F.size("item_words")), F.lit(0))).first()[0]
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    if total <= sent_words:
        found = docs.mapInArrow(_search(_sent_items(known, windows), max_edits), "doc_id bigint, item_id bigint, run bigint, edits bigint")
    else:
        found = _joined(docs, known, windows, total).mapInArrow(_verify(max_edits), "doc_id bigint, item_id bigint, run bigint, edits bigint")
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.min("edits").alias("edits"))


def _sent_items(known: DataFrame, windows: DataFrame):
    """The sorted windows of every table, and the items, sent to the executors."""
    import numpy as np

    t = known.orderBy("item").toArrow().combine_chunks()
    items = (t["item_id"].to_numpy(), *_flat(t["item_words"].combine_chunks()))
    w = windows.toArrow()
    key, table, item, j = (w[c].to_numpy() for c in ("key", "table", "item", "j"))
    item = np.searchsorted(t["item"].to_numpy(), item)
    tables = []
    for k in range(len(sampled_positions())):
        mine = np.flatnonzero(table == k)
        mine = mine[np.argsort(key[mine], kind="stable")]
        tables.append((key[mine], item[mine], j[mine].astype("int64")))
    return known.sparkSession.sparkContext.broadcast((tables, items))


def _joined(docs: DataFrame, known: DataFrame, windows: DataFrame, total: int) -> DataFrame:
    """(doc_id, words, item_id, item_words, pairs): documents and items with
    windows of equal keys.  A sketch of the items' keys lets windows pass."""
    import numpy as np

    bits = min(MOST_BITS, max(LEAST_BITS, (64 * total).bit_length()))
    place = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    set_bits = windows.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("word")).toArrow()
    sketch = np.zeros(1 << (bits - 6), dtype="uint64")
    sketch[set_bits["at"].to_numpy()] = set_bits["word"].to_numpy().view("uint64")
    sent = docs.sparkSession.sparkContext.broadcast(sketch)
    hits = docs.mapInArrow(_hits(sent, bits), "doc_id bigint, words array<bigint>, at array<int>, keys array<bigint>")
    hits = stored(hits.withColumn("row", F.monotonically_increasing_id()), "hits")
    asked = hits.select("row", F.explode(F.arrays_zip("at", "keys")).alias("w")).select("row", "w.at", F.col("w.keys").alias("key"))
    pairs = asked.join(windows, "key").groupBy("row", "item").agg(F.collect_set(F.struct("at", "j")).alias("pairs"))
    return pairs.join(hits.select("row", "doc_id", "words"), "row").join(known, "item").select("doc_id", "words", "item_id", "item_words", "pairs")


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p8_found: (doc_id, item_id) with a run of at least MIN_RUN words."""
    return leaked_items(documents, items).where(F.col("run") >= MIN_RUN).select("doc_id", "item_id")

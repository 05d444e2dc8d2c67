"""Near-duplicate pages by an LSH forest.

Every text becomes a MinHash signature over its runs of three words.  A tree
of the forest is one order of the signature's values; pages are sorted by it,
and pages whose longest common prefix in some tree is as long as the region's
depth are candidates.  The depth is two; pages of a prefix that too many share
go down to a depth of four, and six, where more trees keep the recall, and are
compared there instead.  A pair that shares no quiet prefix at a depth shares
crowded ones only, so both of its pages go down.  The pages of a prefix that
one task doesn't hold are dealt into parts of which every two meet in a task of
their own, and are compared block by block.

Candidates are compared by sketches where they meet: up to SHORT runs by parity
sketches, whose differing bits never outnumber the differing runs, beyond by
MinHash values.  What is left is verified exactly on the sets of runs.  Texts
with equal sets are one class, searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.leaks import _Hashes, words_of
from quarrymill.session import stored

SHINGLE, THRESHOLD = 3, 0.6
VALUES = 64
#: Depth and trees of each level.  A pair of similarity 0.6 shares the first values in some tree of a level with
#: probability 0.9994, 0.9965 and 0.975 (simulated; trees of a level share values), one of 0.65 with 1, 0.9994 and 0.995.
LEVELS = ((2, 16), (4, 64), (6, 160))
#: A pair of similarity 0.6 agrees in fewer values of a signature with probability under 0.0003.
ESTIMATE = 0.39
#: Runs of a text up to which it has a parity sketch, and the sketch's bits.
SHORT, SKETCH_BITS = 600, 512
#: Pages of a prefix that meet in one task; beyond, they are dealt into parts of about so many.
KEY_ROWS = 50_000
#: Pages of a prefix beyond which they go down a level, but for the last.
CROWD_ROWS = 200_000
#: Pages in a block; larger groups are compared block by block.
GROUP_ROWS = 1_500


def shingles(texts: list[str | None], hashes: _Hashes):
    """Hashes of the distinct runs of SHINGLE words of each text, sorted: (flat, sizes)."""
    import numpy as np

    flat, sizes = [], np.zeros(len(texts), dtype="int64")
    a, b, c = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    for i, text in enumerate(texts):
        words = words_of(text)
        if len(words) >= SHINGLE:
            w = np.fromiter(map(hashes.__getitem__, words), "int64", len(words)).view("uint64")
            h = (w[:-2] * a) ^ ((w[1:-1] >> np.uint64(7)) * b) ^ ((w[2:] >> np.uint64(13)) * c)
            h = np.unique((h ^ (h >> np.uint64(31))) * b)
            flat.append(h)
            sizes[i] = len(h)
    return (np.concatenate(flat) if flat else np.zeros(0, "uint64")), sizes


def _signatures(threshold: float):
    """(id, digest, n, sig, sketch): the class of a text, its number of runs,
    its signature, and its sketch: parities, low bytes of the values, or in the
    sizes where both kinds may meet, both."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(20240229)
        mult, add = (rng.integers(1, 1 << 32, VALUES, dtype="uint64") | 1).astype("uint32"), rng.integers(0, 1 << 32, VALUES, dtype="uint64").astype("uint32")
        hashes = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                flat, sizes = shingles(b["text"].to_pylist(), hashes)
                full = np.flatnonzero(sizes)
                if not len(full):
                    continue
                n = sizes[full]
                starts = np.cumsum(n) - n
                x = (flat >> np.uint64(32)).astype("uint32")
                sig = np.empty((len(full), VALUES), dtype="uint16")
                for v in range(VALUES):
                    h = x * mult[v] + add[v]
                    h ^= h >> np.uint32(15)
                    h *= np.uint32(0x85EBCA6B)
                    low = np.minimum.reduceat(h, starts)
                    sig[:, v] = ((low ^ (low >> np.uint32(16))) & np.uint32(0xFFFF)).astype("uint16")
                place = ((flat * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype("int64") % SKETCH_BITS
                odd = np.bincount(np.repeat(np.arange(len(n)), n) * SKETCH_BITS + place, minlength=len(n) * SKETCH_BITS) & 1
                odd = np.packbits(odd.astype("uint8").reshape(len(n), SKETCH_BITS), axis=1).tobytes()
                low = (sig & 0xFF).astype("uint8").tobytes()
                width = SKETCH_BITS // 8
                sketch = [(odd[i * width : (i + 1) * width] if k <= SHORT / threshold else b"") + (low[i * VALUES : (i + 1) * VALUES] if k > SHORT else b"") for i, k in enumerate(n.tolist())]
                digest = np.add.reduceat(flat * np.uint64(0xFF51AFD7ED558CCD) ^ (flat >> np.uint64(17)), starts).view("int64")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype="int32") * VALUES), pa.array(sig.astype("int32").ravel()))
                yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(full)), pa.array(digest), pa.array(n), lists, pa.array(sketch, pa.binary())], names=["id", "digest", "n", "sig", "sketch"])

    return run


def most_differing(total, threshold: float):
    """Differing bits of the parity sketches of two sets of ``total`` runs
    together from which their similarity is below ``threshold``: the number of
    runs that may differ, or less where bits collide (by four deviations)."""
    import numpy as np

    runs = total * (1 - threshold) / (1 + threshold)
    kept = np.exp(-4 * runs / SKETCH_BITS)
    mean = SKETCH_BITS / 2 * (1 - np.exp(-2 * runs / SKETCH_BITS))
    return np.minimum(runs, mean + 4 * np.sqrt(np.maximum(SKETCH_BITS / 4 * (1 - kept) - runs * kept, 0) + 1))


def _neighbours(threshold: float, group_rows: int):
    """Candidate pairs of the rows of each (key, p, q), which come one after
    the other: rows of part p with rows of part q, or all where p is q."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        least = int(np.ceil(ESTIMATE * VALUES * threshold / THRESHOLD))
        width = SKETCH_BITS // 64

        def by_parity(x, y, n, odd):
            """Pairs of rows x and y whose parities differ in few enough bits."""
            apart = np.zeros((len(x), len(y)), dtype="uint16")
            for w in range(width):
                apart += np.bitwise_count(odd[w, x][:, None] ^ odd[w, y][None, :])
            limit = most_differing(np.arange(2 * int(n.max()) + 1), threshold).astype("uint16")
            r, c = np.nonzero(apart <= limit[n[x][:, None] + n[y][None, :]])
            return x[r], y[c]

        def by_values(x, y, n, low):
            """Pairs of which one at least is long, by the number of equal values."""
            same = np.zeros((len(x), len(y)), dtype="uint8")
            for v in range(VALUES):
                same += low[v, x][:, None] == low[v, y][None, :]
            r, c = np.nonzero((same >= least) & ((n[x] > SHORT / threshold)[:, None] | (n[y] > SHORT / threshold)[None, :]))
            return x[r], y[c]

        def compare(ids, n, sketch, second):
            rows = np.arange(len(ids))
            has_odd, has_low = n <= SHORT / threshold, n > SHORT
            odd, low = np.zeros((len(ids), width), dtype="uint64"), np.zeros((len(ids), VALUES), dtype="uint8")
            if has_odd.any():
                odd[has_odd] = np.frombuffer(b"".join([x[: width * 8] for x, k in zip(sketch, has_odd, strict=True) if k]), "<u8").reshape(-1, width)
            if has_low.any():
                low[has_low] = np.frombuffer(b"".join([x[-VALUES:] for x, k in zip(sketch, has_low, strict=True) if k]), "uint8").reshape(-1, VALUES)
            odd, low = np.ascontiguousarray(odd.T), np.ascontiguousarray(low.T)
            crossed = second.any()
            for kind, near, data in ((has_odd, by_parity, odd), (has_low, by_values, low)):
                if not kind.any() or near is by_values and not (n > SHORT / threshold).any():
                    continue
                x, y = (rows[kind & ~second], rows[kind & second]) if crossed else (rows[kind], rows[kind])
                for i in range(0, len(x), 256):
                    for j in range(0 if crossed else i, len(y), group_rows):
                        a, b = near(x[i : i + 256], y[j : j + group_rows], n, data)
                        if not crossed:
                            a, b = a[b > a], b[b > a]  # each pair once
                        if len(a):
                            yield ids[a], ids[b]

        def groups():
            """(ids, n, sketch, second) of each (key, p, q)."""
            rest: list = []
            before = None
            for b in batches:
                if not b.num_rows:
                    continue
                key = np.stack([b[c].to_numpy() for c in ("key", "p", "q")], axis=1)
                got = [b["id"].to_numpy(), b["n"].to_numpy(), np.array(b["sketch"].to_pylist(), dtype=object), b["second"].to_numpy(zero_copy_only=False)]
                starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
                if rest and (before != key[0]).any():
                    yield [np.concatenate(x) for x in zip(*rest, strict=True)]
                    rest = []
                for s, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows], strict=True):
                    rest.append([x[s:e] for x in got])
                    if e < b.num_rows:
                        if e - s > 1 or len(rest) > 1:
                            yield [np.concatenate(x) for x in zip(*rest, strict=True)]
                        rest = []
                before = key[-1]
            if rest:
                yield [np.concatenate(x) for x in zip(*rest, strict=True)]

        def pairs(out):
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            t = pa.table({"a": lo, "b": hi}).group_by(["a", "b"]).aggregate([])
            return t.select(["a", "b"]).combine_chunks().to_batches(max_chunksize=100_000)

        out, waiting = [], 0
        for ids, n, sketch, second in groups():
            if len(ids) < 2 or (second.any() and second.all()):
                continue
            for found in compare(ids, n, sketch, second):
                out.append(found)
                waiting += len(found[0])
                if waiting > 200_000 or len(out) > 10_000:
                    yield from pairs(out)
                    out, waiting = [], 0
        if out:
            yield from pairs(out)

    return run


def _sets(batches: Iterator) -> Iterator:
    """(id, runs) of texts."""
    import numpy as np
    import pyarrow as pa

    hashes = _Hashes()
    for b in batches:
        flat, sizes = shingles(b["text"].to_pylist(), hashes)
        yield pa.RecordBatch.from_arrays([b["id"], pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype("int32")), pa.array(flat.view("int64")))], names=["id", "runs"])


def _short(batches: Iterator) -> Iterator:
    """(id, words) of the texts without runs; null where there is no word."""
    import pyarrow as pa

    for b in batches:
        words = [words_of(text) for text in b["text"].to_pylist()]
        at = [i for i, w in enumerate(words) if len(w) < SHINGLE]
        yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at, "int64")), pa.array([" ".join(words[i]) or None for i in at], "string")], names=["id", "words"])


def orders(depth: int, trees: int) -> list[list[int]]:
    """The first ``depth`` values of each tree: disjoint ones as far as they
    go, then those of another shuffle."""
    import random

    rng, out = random.Random(depth), []
    while len(out) < trees:
        values = list(range(VALUES))
        rng.shuffle(values)
        out += [values[i : i + depth] for i in range(0, VALUES - depth + 1, depth)]
    return out[:trees]


def _candidates(classes: DataFrame, threshold: float, key_rows: int, crowd_rows: int, group_rows: int) -> DataFrame:
    """(a, b) of the pages (id, n, sig, sketch) that meet in a tree and whose sketches are near."""
    found = None
    for level, (depth, trees) in enumerate(LEVELS):
        keys = F.array(*(F.xxhash64(F.lit(t), *(F.col("sig")[i] for i in order)) for t, order in enumerate(orders(depth, trees))))
        keyed = classes.select("id", "n", "sketch", F.explode(keys).alias("key"))
        # few rows: at most trees * classes / key_rows
        crowded = stored(keyed.groupBy("key").count().where(F.col("count") > key_rows).select("key", F.ceil(F.col("count") / key_rows).cast("int").alias("parts"), (F.col("count") > crowd_rows if level < len(LEVELS) - 1 else F.lit(False)).alias("down")), "crowded")
        alone = [F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(False).alias("second")]
        many = crowded.count()
        down = many and not crowded.where("down").isEmpty()
        if not many:
            rows = keyed.select("key", "id", "n", "sketch", *alone)
        else:
            side = F.broadcast(crowded) if many <= 200_000 else crowded
            dealt = keyed.join(side, "key", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
            split = dealt.where("not down").withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
            split = split.select("key", "id", "n", "sketch", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("part") > F.col("other")).alias("second"))
            rows = dealt.where("parts is null").select("key", "id", "n", "sketch", *alone).unionByName(split)
        near = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_neighbours(threshold, group_rows), "a bigint, b bigint")
        found = near if found is None else found.unionByName(near)
        if not down:
            break
        below = dealt.where("down").select("id").distinct()
        classes = stored(classes.join(below, "id", "left_semi"), "crowded-pages")
    return found.distinct()


class NearDuplicates:
    """The classes of equal texts and the links between similar ones.

    ``classes``: (id, class_id) of every id whose text has SHINGLE words or
    more; class_id is the least id with the same set of runs.
    ``links``: (a, b, similarity) of class ids a < b with a similarity of at
    least ``threshold``.
    """

    def __init__(self, docs: DataFrame, id_col: str = "id", text_col: str = "body_text", threshold: float = THRESHOLD, key_rows: int = KEY_ROWS, crowd_rows: int = CROWD_ROWS, group_rows: int = GROUP_ROWS):
        self.rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
        rows = self.rows.where("text is not null")
        signed = stored(rows.mapInArrow(_signatures(threshold), "id bigint, digest bigint, n bigint, sig array<int>, sketch binary"), "signatures")
        same = signed.groupBy("digest", "n").agg(F.min("id").alias("class_id"))
        self.classes = signed.select("id", "digest", "n").join(same, ["digest", "n"]).select("id", "class_id").distinct()
        # one row per class: the text delivered again, and every copy, is left out here
        one = F.struct("sig", "sketch")
        classes = signed.groupBy("digest", "n").agg(F.min_by(one, "id").alias("s"), F.min("id").alias("id")).select("id", "n", "s.*")
        near = stored(_candidates(classes, threshold, key_rows, crowd_rows, group_rows), "candidates")
        wanted = stored(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate-ids")
        # one delivery of each text is enough
        sets = rows.join(wanted, "id", "left_semi").mapInArrow(_sets, "id bigint, runs array<bigint>").dropDuplicates(["id"])
        pairs = near.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("runs").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        self.links = pairs.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)

    def pairs(self) -> DataFrame:
        """(id_a, id_b) of all similar ids, copies expanded, id_a < id_b."""
        left, right = self.classes.select(F.col("id").alias("x"), F.col("class_id").alias("a")), self.classes.select(F.col("id").alias("y"), F.col("class_id").alias("b"))
        other = self.links.join(left, "a").join(right, "b").select("x", "y")
        copies = left.join(right, F.col("a") == F.col("b")).where("x < y").select("x", "y")
        return other.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """(id, class_id, links): one row per id; the number of other classes its class is linked with.

        Texts without runs have no links; those of the same words are one class, and each without words is its own."""
        ends = self.links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
        short = self.rows.mapInArrow(_short, "id bigint, words string").groupBy("id").agg(F.min("words").alias("words")).join(self.classes, "id", "left_anti")
        same = short.where("words is not null").groupBy("words").agg(F.min("id").alias("class_id"))
        classes = self.classes.unionByName(short.join(same, "words", "left").select("id", F.coalesce("class_id", "id").alias("class_id")))
        return classes.join(ends, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def near_duplicates(docs: DataFrame, **options) -> NearDuplicates:
    """Near-duplicates of ``docs`` by the similarity (Jaccard) of their sets of
    runs of SHINGLE words; see ``NearDuplicates``.

    Defined cases: null ids or texts, and texts of fewer than SHINGLE words,
    are in no class and pair (``groups`` has a row for all but null ids); an id delivered again counts once; equal texts share a
    class and are similar; an empty table gives none; texts are taken whole;
    further columns are ignored.
    """
    return NearDuplicates(docs, **options)


def url_key(url: Column) -> Column:
    """A url without scheme, host, query, fragment, letter case, a final
    index.html or .html, and then final slashes."""
    path = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    path = F.lower(F.regexp_replace(path, r"(?s)[?#].*$", ""))
    return F.regexp_replace(F.regexp_replace(path, r"(index\.html|\.html)$", ""), "/+$", "")


def same_url(docs: DataFrame) -> DataFrame:
    """(id_a, id_b) of the ids of one site whose urls agree in ``url_key``;
    null ids, sites and urls agree with none."""
    keyed = docs.where("id is not null and site is not null and url is not null").select("id", "site", url_key(F.col("url")).alias("key")).distinct()
    return keyed.select(F.col("id").alias("id_a"), "site", "key").join(keyed.select(F.col("id").alias("id_b"), "site", "key"), ["site", "key"]).where("id_a < id_b").select("id_a", "id_b")


def page_groups(indexable: DataFrame, search: DataFrame) -> DataFrame:
    """(id, class_id, links, url_id) of every id: its class and links by text
    as in ``groups``, and the least id whose url is another spelling of its own
    on the same site.  A page with several urls takes the least of these; one
    without a url, or a site, has its own id."""
    keyed = search.where("id is not null and site is not null and url is not null").select("id", "site", url_key(F.col("url")).alias("key"))
    least = keyed.groupBy("site", "key").agg(F.min("id").alias("url_id"))
    urls = keyed.join(least, ["site", "key"]).groupBy("id").agg(F.min("url_id").alias("url_id"))
    return near_duplicates(indexable).groups().join(urls, "id", "left").withColumn("url_id", F.coalesce("url_id", "id"))


def found(indexable: DataFrame, search: DataFrame) -> DataFrame:
    """p5_found: (id_a, id_b), similar by text or one page by url."""
    return near_duplicates(indexable).pairs().unionByName(same_url(search)).distinct()

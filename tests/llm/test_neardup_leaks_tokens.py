"""Near-duplicates (5), token ids (7) and leaked items (8)."""

import random

import pytest

from quarrymill.llm import leaks, neardup, tokens

PAGE = "id bigint, body_text string, sig string, n int"


def runs(text):
    w = leaks.words_of(text)
    return set(zip(w, w[1:], w[2:], strict=False))


def similar(data):
    d = {i: runs(t) for i, t, *_ in data if i is not None and t is not None}
    ids = sorted(i for i in d if d[i])
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(d[a] & d[b]) / len(d[a] | d[b]) >= 0.6}


def texts(rng, n, size=60):
    return [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(size)) for _ in range(n)]


@pytest.mark.parametrize(("options", "short"), [({}, 600), ({"key_rows": 3, "group_rows": 8}, 600), ({"key_rows": 3, "group_rows": 8}, 50), ({}, 10), ({"key_rows": 3, "crowd_rows": 3}, 600)])
def test_pairs_against_brute_force(spark, monkeypatch, options, short):
    monkeypatch.setattr(neardup, "SHORT", short)  # runs up to which parities are compared; near it both kinds are
    rng = random.Random(8)
    data = []
    for k, t in enumerate(texts(rng, 30)):
        w = t.split()
        for v in range(4):
            e = list(w)
            for _ in range(v * 2):
                e[rng.randrange(len(e))] = "edit" + str(rng.randint(0, 999))
            data.append((k * 10 + v, " ".join(e), "x", 1))
    data += [(5_000 + i, "one two three four", "x", 1) for i in range(12)] + [(5_000, "one two three four", "x", 1)]
    data += [(9_000, None, "x", 1), (None, "one two three four", "x", 1), (9_001, "", "x", 1), (9_002, "two words", "x", 1), (9_003, "word " * 50_000, "x", 1)]
    want = similar(data)
    got = {tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(data, PAGE), **options).pairs().distinct().collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_recall_of_each_level():
    """A pair of similarity 0.62 agrees in each value of its signatures with that probability."""
    import numpy as np

    agree = np.random.default_rng(1).random((20_000, neardup.VALUES)) < 0.62
    for depth, trees in neardup.LEVELS:
        hit = np.zeros(len(agree), dtype=bool)
        for order in neardup.orders(depth, trees):
            assert len(set(order)) == depth
            hit |= agree[:, order].all(axis=1)
        assert hit.mean() > 0.98


def test_parity_sketches_never_reject_similar_sets():
    import numpy as np

    rng = np.random.default_rng(3)
    for total in (10, 60, 200, 600, 1200):
        shared = int(np.ceil(0.6 * total / 1.6))  # two sets of half the total each, of similarity 0.6 or a little more
        differing = total - 2 * shared
        bits = np.array([(np.bincount(rng.integers(0, neardup.SKETCH_BITS, differing), minlength=neardup.SKETCH_BITS) & 1).sum() for _ in range(2_000)])
        assert (bits <= neardup.most_differing(np.array([total]), 0.6)).all()


def test_a_crowded_group_keeps_its_pairs():
    """5,000 pages under one prefix at production parameters: twins that share 0.6 or more must all be found, and under a fiftieth of the other pairs, whose similarity is 0.49."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    rng, n = random.Random(5), 5_000
    template = [f"t{i}" for i in range(80)]
    texts = []
    for _ in range(n // 2):
        own = [f"s{rng.randrange(10**9)}" for _ in range(20)]
        texts += [" ".join(template + own + [f"o{rng.randrange(10**9)}" for _ in range(20)]) for _ in range(2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts)], names=["id", "text"])
    t = pa.Table.from_batches(list(neardup._signatures(0.6)(iter([batch])))).combine_chunks()
    place = sorted(range(n), key=lambda i: hashlib.md5(str(i).encode()).digest())
    rows = t.take(pa.array(place))
    columns = {"key": np.zeros(n, "int64"), "p": np.zeros(n, "int32"), "q": np.zeros(n, "int32"), "id": rows["id"], "n": rows["n"], "sketch": rows["sketch"], "second": np.zeros(n, bool)}
    found = neardup._neighbours(0.6, neardup.GROUP_ROWS)(iter(pa.table(columns).combine_chunks().to_batches(max_chunksize=700)))
    got = {p for b in found for p in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)}
    want = {(i, i + 1) for i in range(0, n, 2)}
    assert want <= got and len(got) < 0.02 * n * n / 2


@pytest.mark.parametrize(("crowd", "least"), [(10**6, 0.995), (100, 0.98), (20, 0.95)])
def test_recall_in_a_crowded_prefix(spark, crowd, least):
    """600 pages on one template meet under the same prefixes, dealt into many parts or sent down the levels; only twins reach 0.6."""
    rng = random.Random(5)
    template = " ".join(f"t{i}" for i in range(42))
    data = []
    for k in range(300):
        shared = " ".join(f"s{rng.randrange(10**9)}" for _ in range(7))
        data += [(2 * k + v, f"{template} {shared} " + " ".join(f"o{rng.randrange(10**9)}" for _ in range(11)), "x", 1) for v in range(2)]
    want = similar(data)
    got = {tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(data, PAGE), key_rows=min(60, crowd), crowd_rows=crowd, group_rows=10).pairs().collect()}
    assert len(want) == 300 and got <= want and len(got) >= least * len(want)


def test_groups_have_a_row_per_id(spark):
    data = [(1, "a b c d e f g h", "x", 1), (2, "a b c d e f g h", "x", 1), (3, "a b c d e f g i", "x", 1), (4, "z y x w", "x", 1)]
    got = {r["id"]: (r["class_id"], r["links"]) for r in neardup.near_duplicates(spark.createDataFrame(data, PAGE)).groups().collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0)}


def test_groups_hold_short_and_missing_texts(spark):
    data = [(1, "a b c d e", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, "Two words", "x", 1), (5, "two, words!", "x", 1), (5, "two words", "x", 1), (None, "a b", "x", 1), (6, "...", "x", 1)]
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(data, PAGE)).groups().collect()))
    assert got == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 4, 0), (6, 6, 0)]


def test_no_pages(spark):
    empty = spark.createDataFrame([], PAGE)
    assert neardup.near_duplicates(empty).pairs().count() == 0 and neardup.near_duplicates(empty).groups().count() == 0


def test_groups_of_pages(spark):
    pages = spark.createDataFrame([(1, "a b c d e f g h", "x", 1), (2, "a b c d e f g h", "x", 1), (3, None, "x", 1), (4, "q r s t", "x", 1)], PAGE)
    urls = spark.createDataFrame([(4, "s", "/docs/A"), (2, "s", "/docs/a.html"), (3, "s", None), (1, "t", "/docs/a"), (2, "s", "/docs/a.html")], "id bigint, site string, url string")
    assert sorted(map(tuple, neardup.page_groups(pages, urls).select("id", "class_id", "links", "url_id").collect())) == [(1, 1, 0, 1), (2, 1, 0, 2), (3, 3, 0, 3), (4, 4, 0, 2)]


def test_urls(spark):
    rows = [(1, "s", "https://S.example/Docs/A/index.html?x=1#y"), (2, "s", "/docs/a.html"), (3, "s", "http://other/docs/a//"), (4, "s", "/docs/b"), (5, "t", "/docs/a"), (6, "s", None), (None, "s", "/docs/a"), (7, None, "/docs/a"), (8, "s", "https://s.example"), (9, "s", "/index.html"), (2, "s", "/docs/a.html")]
    got = {tuple(r) for r in neardup.same_url(spark.createDataFrame(rows, "id bigint, site string, url string")).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (8, 9)}


DOC = "doc_id bigint, text string, ids string, run int"


@pytest.mark.parametrize(("sent", "bits"), [(10**6, 27), (0, 6), (0, 27)])
def test_leaks_against_brute_force(spark, monkeypatch, sent, bits):
    monkeypatch.setattr(leaks, "MOST_BITS", bits)  # 6: a sketch so full that it lets every window through
    monkeypatch.setattr(leaks, "LEAST_BITS", 6)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 12, 30, 60])))) for i in range(8)] + [(None, "x"), (90, None), (91, "")]
    docs = []
    for d in range(120):
        w = rng.choices(vocabulary, k=rng.randint(0, 80))
        if d % 2:
            item = items[d % 8][1].split()
            n = rng.randint(8, 20)
            at = rng.randint(0, max(0, len(item) - n))
            w[len(w) // 2 : len(w) // 2] = item[at : at + n]
        docs.append((d, "  ".join(w).upper().replace("  ", ", "), "x", 1))
    docs += [(500, None, "x", 1), (None, items[2][1], "x", 1), (501, "", "x", 1), docs[3], (502, "filler " * 30_000 + items[3][1], "x", 1)]

    def grams(text):
        w = leaks.words_of(text)
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(d, i) for d, t, *_ in docs if d is not None for i, x in items if i is not None and grams(t) & grams(x)}
    D, I = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id bigint, text string")
    got = leaks.leaked_items(D, I, sent_words=sent)
    assert {(r["doc_id"], r["item_id"]) for r in got.where("run >= 12").collect()} == want
    assert (502, 3) in want and len(want) > 20


@pytest.mark.parametrize("sent", [0, 10**6])
def test_short_overlaps_at_ends_are_no_leaks(spark, sent):
    """8 to 11 shared words at either end of texts, among neighbours in a batch; texts of 8 words are too short."""
    item = [f"w{i}" for i in range(40)]
    docs = []
    for n in range(8, 13):
        for where in range(4):
            own = [f"d{n}{where}{i}" for i in range(20)]
            docs.append((n * 10 + where, " ".join([own + item[-n:], item[:n] + own, item[-n:] + own, own + item[:n]][where]), "x", 1))
    docs += [(1, " ".join(item[:8]), "x", 1), (2, " ".join(item[-11:]), "x", 1)]
    items = [(1, " ".join(item)), (2, " ".join(item[:8])), (3, " ".join(item[-11:]))]
    got = {(r["doc_id"], r["item_id"]): r["run"] for r in leaks.leaked_items(spark.createDataFrame(docs, DOC).coalesce(1), spark.createDataFrame(items, "item_id bigint, text string"), sent_words=sent).collect()}
    assert got == {(120 + where, 1): 12 for where in range(4)}


def test_runs_of_any_length(spark):
    long = [f"w{i}" for i in range(10_000)]
    docs = [(1, " ".join(["x"] * 7 + long + ["y"]), "x", 1), (2, " ".join(long[:13] + ["y"] * 20), "x", 1)]
    got = {r["doc_id"]: (r["run"], r["edits"]) for r in leaks.leaked_items(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, " ".join(long))], "item_id bigint, text string")).collect()}
    assert got[1] == (10_000, 0) and got[2][0] == 13


def test_short_items_with_edits(spark):
    """An item of 14 words allows edits in proportion, whatever stands around its copy."""
    item = [f"w{i}" for i in range(14)]
    docs = [(k, " ".join(["a"] * 10 + item[:k] + ["edit"] + item[k + 1 :] + ["b"] * 10), "x", 1) for k in (2, 11)] + [(20, " ".join(["a"] * 10 + item[:8] + ["b"] * 16), "x", 1)]
    got = {r["doc_id"]: r["edits"] for r in leaks.leaked_items(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()}
    assert got == {2: 1, 11: 1}


def test_edited_passages(spark):
    rng = random.Random(4)
    item = [f"w{i}" for i in range(40)]
    docs, edited = [], 60
    for d in range(edited):
        e = list(item)
        for p in sorted(rng.sample(range(4, 36), 3), reverse=True):
            if rng.random() < 0.5:
                e[p] = "edit"
            else:
                del e[p]
        docs.append((d, " ".join(["before"] * 9 + e + ["after"] * 9), "x", 1))
    docs.append((999, " ".join(f"v{i}" for i in range(60)), "x", 1))
    got = {r["doc_id"] for r in leaks.leaked_items(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()}
    assert 999 not in got and len(got) >= 0.9 * edited


def test_edit_distance():
    import numpy as np

    x = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4]])
    y = np.array([[1, 2, 3, 4], [2, 3, 4, 5], [9, 9, 9, 9]])
    assert leaks.edit_distance(x, y).tolist() == [0, 2, 4]
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 4, (300, 9)), rng.integers(0, 4, (300, 7))

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, p in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, q in enumerate(b):
                last, row[j + 1] = row[j + 1], min(last + (p != q), row[j] + 1, row[j + 1] + 1)
        return row[-1]

    assert leaks.edit_distance(x, y).tolist() == [plain(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True)]


@pytest.mark.parametrize("most", [5, 1 << 40])
def test_distinct_rows(most):
    import numpy as np

    rng = np.random.default_rng(4)
    columns = [rng.integers(-3, 3, 500) * most for _ in range(3)]
    rows, back = leaks.distinct_rows(*columns)
    assert all((r[back] == c).all() for r, c in zip(rows, columns, strict=True)) and len(set(zip(*rows, strict=True))) == len(rows[0])


def test_nothing_to_search(spark):
    D, I = spark.createDataFrame([], DOC), spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a " * 20, "x", 1)], DOC)
    assert leaks.leaked_items(D, I).count() == 0 and leaks.leaked_items(some, I).count() == 0


@pytest.mark.parametrize("head", [0, 3, 100_000])
def test_ids_agree_with_the_tokenizer(spark, head):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(6)
    alphabet = list("aZé漢🙂0 '\t\n\r\x0b\x1c\x85\xa0　​.,!-_²") + ["'s", "'ll", "<|endoftext|>", "   ", " the", "\n\n"]
    data = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 40))), "x", 1) for i in range(1500)] + [(-1, None, "x", 1), (-2, "", "x", 1), (7, "again", "x", 1), (None, "null id", "x", 1), (-3, "long " * 40_000, "x", 1)]
    out = tokens.encode_corpus(spark.createDataFrame(data, DOC), head_words=head)
    got = sorted(((r["doc_id"], list(r["ids"])) for r in out.collect()), key=str)
    assert got == sorted(((i, t.encode(x or "", add_special_tokens=False).ids) for i, x, *_ in data), key=str)
    decoded = sorted(map(tuple, tokens.decode_corpus(out).collect()), key=str)
    assert decoded == sorted(((i, x or "") for i, x, *_ in data), key=str)


def test_words_and_empty_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert tokens.encode_corpus(empty).count() == 0 and tokens.word_table(empty).count() == 0
    odd = tokens.decode_corpus(spark.createDataFrame([(1, [99_999_999]), (2, None), (3, [])], "doc_id bigint, ids array<int>"))
    assert sorted(map(tuple, odd.collect())) == [(1, None), (2, None), (3, "")]
    words = {r["word"]: r["n"] for r in tokens.word_table(spark.createDataFrame([(1, "a b a", "x", 1), (2, " b", "x", 1)], DOC)).collect()}
    assert words == {"a": 1, " b": 2, " a": 1}

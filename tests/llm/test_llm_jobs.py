"""Operators as Spark jobs on small tables, with nulls, empties, long texts, ties, repeats and
clashing columns, held against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluicebox.llm import components, contamination, exact, html, jaccard, lines, maxent, packing, quality, secrets, suffixes
from sluicebox.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, mark string, root int, n int, block string, spans string"


def brute_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    base = [[draw.choice(vocabulary) for _ in range(draw.randint(20, 90))] for _ in range(8)]
    out = [(0, None), (1, ""), (2, "   \n\t "), (3, "one two"), (4, "One TWO"), (5, "one two three four five")]
    for k, b in enumerate(base):
        for copy in range(6):
            w = list(b)
            for _ in range(copy * len(b) // 40):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            out.append((100 + 10 * k + copy, " ".join(w)))
    # one large group of near copies with different distances, and exact copies in another case
    hot = [draw.choice(vocabulary) for _ in range(120)]
    for copy in range(60):
        w = list(hot)
        for _ in range(copy % 8):
            w[draw.randrange(len(w))] = draw.choice(vocabulary)
        out.append((1000 + copy, " ".join(w).title() if copy % 5 == 0 else " ".join(w)))
    out += [(2000, "long " + " ".join(draw.choice(vocabulary) for _ in range(30_000))), (2001, "ÄÖ ß " * 60), (2002, "The " * 300)]
    return [*out, (103, dict(out)[103]), (None, "null id text of some five words"), (None, None), (3, "one two three and another text")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t) if t else None, "clash", None, 1, None, "b", "s") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, rows, empty):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().lower()].append(i)
    got = collections.Counter(tuple(r) for r in exact.exact_duplicates(docs, block=64).collect())
    assert sum(got.values()) == len(rows)
    kept = collections.Counter()
    for (i, keep, size, stays, sha), n in got.items():
        same = next(g for t, g in groups.items() if hashlib.sha256(t).hexdigest() == sha)
        assert size == len(same) and i in same
        assert keep == max((x for x in same if x is not None), default=None)
        kept[sha] += n * stays
    assert set(kept.values()) == {1}
    assert exact.exact_duplicates(empty).count() == 0


def test_near(docs, rows, empty):
    sets = []
    for _, t in rows:
        w = brute_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    expected = []
    for i, (doc, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        expected.append((doc, len(sets[i]), (min(own, default=None) if sets[i] else doc)))
    key = lambda r: tuple((x is None, x) for x in r)
    # columns of 3 nodes count as long, so groups go through tiles
    got = [tuple(r)[:3] for r in jaccard.near_duplicates(docs, longest=3, often=3).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert jaccard.near_duplicates(empty).count() == 0
    stay = jaccard.one_of_each(docs)
    assert stay.columns == docs.columns
    words = {(r.doc_id, r.text) for r in stay.collect()}
    assert len(words) == stay.count()
    assert len({top(i) for i in range(len(rows)) if sets[i]}) == sum(bool(brute_words(t)) for _, t in words)


def brute_repeats(rows):
    order = sorted({(-1 << 63 if i is None else i, t or "") for i, t in rows})
    seen, out = set(), {}
    for i, t in order:
        data = t.encode()
        cover = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        kept = bytes(x for x, c in zip(data, cover, strict=True) if not c)
        out[i, t] = (len(data), len(data) - len(kept), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark, docs, rows, empty):
    plain = [(i, t) for i, t in rows if i != 3]  # two texts of one id have no stated order
    expected = brute_repeats(plain)
    got = suffixes.remove_repeats(docs.where("doc_id is null or doc_id <> 3")).collect()
    assert len(got) == len(plain)
    texts = collections.defaultdict(set)
    for i, t in plain:
        texts[i].add(t or "")
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in {expected[-1 << 63 if r.doc_id is None else r.doc_id, t] for t in texts[r.doc_id]}
    assert suffixes.remove_repeats(empty).count() == 0


def test_packing(spark, docs, rows, empty):
    got = packing.pack(docs, batch=20).collect()
    encode = packing.encoder(packing.VOCABULARY)
    want = collections.Counter()
    for i, t in rows:
        ids = [*encode(t or ""), 1]
        want[i, len(ids)] += 1
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length))
    assert {k: sum(n for _, n in v) for k, v in pieces.items()} == {k: k[1] * n for k, n in want.items()}
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert all(a == sum(n for _, n in parts[:k]) for k, (a, _) in enumerate(parts)) and sum(n for _, n in parts) <= 2048
    assert packing.pack(empty).count() == 0
    one = packing.pack(spark.createDataFrame([(9, "hello world")], "doc_id long, text string")).first()
    assert one.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*encode("hello world"), 1]))


def test_language_model(docs, rows, empty):
    counts = collections.Counter()
    tokens = []
    for i, t in rows:
        own = [*brute_words(t), None]
        tokens.append((i, own))
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    got = maxent.score_texts(docs, dictionary=50).collect()
    want = collections.Counter((i, i is None or zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in tokens)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert maxent.score_texts(empty).count() == 0


def test_lines(spark, empty):
    a = "this is a rather long line that several documents have in common"
    b = f"  {a.title()} "
    rows = [(1, f"own first words of one here\n{a}"), (2, f"{b}\nShort one"), (3, a.upper()), (4, "Short one\nother things that nobody else has said"), (5, None), (6, ""), (7, f"{a}\n{a}"), (None, "a line of the null id document\nShort one"), (7, f"{a}\n{a}")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, removed string")
    out = sorted(((r.doc_id, r.text, r.gone) for r in lines.dedup_lines(docs, removed="gone").collect()), key=repr)
    assert out == sorted([(1, f"own first words of one here\n{a}", 0), (2, "Short one", 1), (3, "", 1), (4, rows[3][1], 0), (5, None, 0), (6, "", 0), (7, "", 2), (None, rows[7][1], 0), (7, "", 2)], key=repr)
    assert lines.dedup_lines(empty).count() == 0


def test_fuzzy_lines(spark):
    """The method finds most pairs of long lines that differ in a word, and joins no others."""
    draw = random.Random(12)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    rows = []
    for k in range(60):
        w = [draw.choice(vocabulary) for _ in range(60)]
        rows.append((k, " ".join(w)))
        w[draw.randrange(60)] = "changed"
        rows.append((100 + k, " ".join(w)))
    gone = {r.doc_id for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), removed="gone").where("gone > 0").collect()}
    assert all(k >= 100 for k in gone) and len(gone) >= 42


def test_lines_of_unequal_bytes(spark):
    """Lengths are compared in code points: 9 of 49 added at three bytes each are within the limit."""
    a = "five plain words and a few more to follow"[:40]
    rows = [(1, a), (2, a + "\u6f22\u5b57\u6f22\u5b57\u4eee\u540d\u4eee\u540d\u6587"), (3, "w " * 42 + "xyz"), (4, "w " * 42 + "xyzt")]
    gone = {r.doc_id for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), removed="gone").where("gone > 0").collect()}
    assert gone == {2, 4}


def test_lines_of_few_words(spark):
    """Scripts without spaces and short notices are deduplicated like other lines."""
    a = "\u3053\u306e\u6587\u7ae0\u306f\u7a7a\u767d\u3092\u542b\u307e\u306a\u3044\u3002"
    rows = [(1, a), (2, f"All rights reserved.\n{a}"), (3, "all rights  reserved.")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: a, 2: "All rights reserved.", 3: ""}


def test_secrets(docs, rows, empty):
    got = secrets.scan(docs, None)
    assert got.count() == len(rows) and got.where("spans <> ''").count() == 0
    assert secrets.fit(docs) is None and secrets.scan(empty, None).count() == 0


def test_rare_secrets(spark):
    """Few findings among many documents still train a network."""
    text = F.when(F.col("id") % 6000 == 7, F.concat(F.lit("password: "), F.sha1(F.col("id").cast("string")))).when(F.col("id") % 6000 == 8, F.lit("see page/of/the/manual2024edition")).otherwise("plain words")
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    assert secrets.fit(docs) is not None


def test_secret_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r for r in secrets.scan(docs, secrets.fit(docs)).collect()}
    for r in docs.collect():
        base = secrets.base_spans(r.text)
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert found[r.doc_id].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(found[r.doc_id].spans.split(","))


def test_quality(spark, docs, rows, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality.classify(real, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.97
    none = labels.where("false")
    got = quality.classify(docs, none).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {quality.ACCEPT} and {r.predicted for r in got} == {1}
    assert quality.classify(empty, none).count() == 0


def test_leaks(spark, docs, rows, empty):
    item = rows[20][1][:200]
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (3, "")], "item_id long, text string")
    found = contamination.find_leaks(docs, bench, block_bytes=50)
    hit = {r.doc_id for r in found.where("size(leaks) > 0").collect()}
    assert rows[20][0] in hit and not hit & {0, 1, 2, 3, 2000}
    assert contamination.decontaminate(docs, bench).columns == docs.columns
    assert contamination.decontaminate(docs, bench.where("false")).count() == len(rows)
    assert contamination.find_leaks(empty, bench).count() == 0


def test_pages(spark):
    boiler = "<div><p>Site of the good people</p></div>"
    rows = [(k, f"http://h.example/a/{k}", f"{boiler}<p>Text number {k}</p><p>All rights are ours</p>") for k in range(9)]
    rows += [(20, "http://h.example/a/3#top", rows[3][2]), (21, "http://alone.example/", f"{boiler}<p>x</p>"), (22, None, "<p>no url"), (23, "http://h.example/a/zz", None), (None, "http://h.example/b", "<article><p>marked</p></article>"), (4, rows[4][1], rows[4][2])]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = collections.defaultdict(set)
    for r in html.extract(pages).collect():
        got[r.page_id].add(r.text)
        assert r.n_chars == len(r.text)
    assert all(got[k] == {f"Text number {k}"} for k in range(8)) and got[20] == {"Text number 3"}
    assert got[21] == {"Site of the good people\nx"} and got[22] == {"no url"} and got[23] == {""} and got[None] == {"marked"}
    assert html.extract(pages.where("false")).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected(links, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.connected(links.where("false"), Scratch(spark, "test")).count() == 0


def test_pipeline(spark, folder, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    current = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, SF)
        if k < 4:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        out.write.parquet(f"{folder}/{name}")
        current = spark.read.parquet(f"{folder}/{name}")
    assert current.count() > 0

def test_crowded_keys_of_lines(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(400)]
    rows = []
    for k in range(6):
        base = list(rng.choice(words, 30))
        for copy in range(12):
            own = list(base)
            own[int(rng.integers(30))] = words[int(rng.integers(400))]
            rows.append((k * 100 + copy, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = lines.repeated_lines(docs, longest=2, dense=0).collect()
    assert sorted(r.doc for r in gone) == sorted(i for i, _ in rows if i % 100)


def test_size_of_keys_changes_no_line(spark):
    """Whether pairs of a key are listed or settled in tiles, the same lines go."""
    draw = random.Random(21)
    rows = []
    for k in range(300):
        a = "".join(draw.choice("abcdefghijklmnop   ") for _ in range(240))
        c = list(a)
        for _ in range(22 + k % 8):
            c[draw.randrange(240)] = draw.choice("abcdefghijklmnop")
        rows += [(k, a), (1000 + k, "".join(c))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    listed, settled = ({r.doc for r in lines.repeated_lines(docs, longest=n, dense=m).collect()} for n, m in ((1 << 30, 1 << 30), (2, 0)))
    assert listed == settled and len(listed) > 100


def test_lines_without_partner_are_only_counted(spark, monkeypatch):
    """First occurrences are sought among lines that occur again or resemble another one."""
    kept, keep = {}, lines.Scratch.keep
    monkeypatch.setattr(lines.Scratch, "keep", lambda self, df, name: kept.setdefault(name, keep(self, df, name)))
    a = "this is a rather long line that several documents have in common"
    rows = [(1, f"own first words of one here\n{a}"), (2, "something quite different is said in this place"), (None, f"{a} x"), (3, a)]
    gone = lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc, r.gone) for r in gone) == [(1, [1]), (3, [0])]
    assert kept["per_line"].columns == ["node", "n"]
    assert sorted((r.doc or 0, r.at) for r in kept["repeats"].collect()) == [(0, 0), (1, 1), (3, 0)]


def test_pipeline_verifies_spread_edits(spark):
    """Lines that meet are deduplicated where their edits stand far apart, in the pipeline's stage too."""
    import random

    from corpus_pipeline import STAGES

    draw, rows = random.Random(41), []
    for k in range(60):
        x = [draw.choice("abcdefgh ijkl") for _ in range(90)]
        rows.append((k, "".join(x)))
        x[4::9] = "Q" * len(x[4::9])
        rows.append((1000 + k, "".join(x)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'web' source", "90L n_chars")
    stage = dict(STAGES)["line_dedup"]
    got = {r.doc_id: r.text for r in stage(spark, docs, "/root/testdata/sf0.001").collect()}
    assert all(got[k] == t for k, t in rows[::2])
    assert sum(got[1000 + k] == "" for k in range(60)) >= 30


def test_repeats_need_no_filter(spark, docs, monkeypatch):
    """What is sent follows from the anchors that occur again: nothing of a fixed size is broadcast."""

    def broadcast(self, value):
        raise AssertionError("broadcast")

    expected = {r.doc_id: tuple(r) for r in suffixes.remove_repeats(docs, with_text=False).collect()}
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    assert {r.doc_id: tuple(r) for r in suffixes.remove_repeats(docs, with_text=False).collect()} == expected


def test_all_findings_train(spark, monkeypatch):
    """However many findings there are, each is learned from or calibrates."""
    text = F.concat(F.lit("password: "), F.sha1(F.col("id").cast("string")), F.lit(" see page/of/the/manual"), F.col("id"))
    docs = spark.range(3500).select(F.col("id").alias("doc_id"), text.alias("text"))
    learned, calibrated = [], []
    averaged, calibrate = secrets.averaged, secrets.calibrate
    monkeypatch.setattr(secrets, "averaged", lambda parts: learned.append(sum(p[0] for p in parts)) or averaged(parts))
    monkeypatch.setattr(secrets, "calibrate", lambda m, t, y, n, *more: calibrated.append(n.sum()) or calibrate(m, t, y, n, *more))
    model = secrets.fit(docs, part=1000, epochs=2)
    assert model and learned[0] == learned[1] and learned[0] + calibrated[0] == 10_500 and 2300 < calibrated[0] < 3000

"""Language evidence, repeated passages and the pipeline beside plain versions."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palaver.llm import language, paragraphs, queries


# --- language -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.fit_text_model(docs.where("doc_id % 5 <> 0"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 5 = 0")
    names, weights = model
    judged = language.identify(language.document_evidence(docs.withColumn("lang", F.lit(None).cast("string"))), names, weights)
    rows = judged.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in rows) >= 0.97 * len(rows)
    assert sum(r.accepted for r in rows) >= 0.97 * len(rows)


def plain_trigrams(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    for i in range(2, len(data)):
        c = data[i]
        if c >= 128 or 97 <= c | 32 <= 122:
            code = data[i - 2] << 16 | data[i - 1] << 8 | c
            yield (code * 0x9E3779B1 % 2**32 >> 17) % language.CELLS


def plain_identify(rows, names, weights):
    """(language, certainty, accepted) of rows (text, declared, host, suffix) by loops."""
    real = names[:-1]

    def softmax(logs):
        powers = [math.exp(x - max(logs)) for x in logs]
        return np.array([p / sum(powers) for p in powers])

    def says(said, right):
        if said not in real:
            return np.zeros(len(names))
        other = math.log((1 - right) / max(1, len(real) - 1))
        return np.array([math.log(right) if n == said else other for n in names])

    likelihoods, shares = [], defaultdict(float)
    for text, _, host, suffix in rows:
        cells = list(plain_trigrams(text or ""))
        sums = weights.astype(np.float32)[:, cells].astype(float).sum(axis=1) * min(1.0, language.TEXT_EVIDENCE / max(1, len(cells)))
        likelihoods.append((sums, bool(cells)))
        if cells:
            shares[(host or "").lower(), (suffix or "").lower()] += softmax(sums)
    whole = sum(shares.values(), np.zeros(len(names))) + 1
    whole = whole / whole.sum()
    out = []
    for (text, said, host, suffix), (sums, worded) in zip(rows, likelihoods):
        host, suffix = (host or "").lower(), (suffix or "").lower()
        prior = whole
        if (host, suffix) in shares:
            near = sum(v for (h, s), v in shares.items() if s == suffix)
            up = (near + language.PRIOR_TEXTS * whole) / (near.sum() + language.PRIOR_TEXTS)
            own = shares[host, suffix]
            prior = (own + language.PRIOR_TEXTS * up) / (own.sum() + language.PRIOR_TEXTS)
        declared = says((said or "").split("-")[0].lower(), language.DECLARED)
        post = softmax(sums + declared + says(language.SUFFIX_LANGUAGE.get(suffix), language.SUFFIX) + np.log(prior))
        best = int(np.argmax(post))
        out.append((names[best], round(float(post[best]), 5), worded and names[best] != language.UNKNOWN and post[best] >= language.CERTAIN))
    return out


def test_fusion_equals_loops(spark, sf, model):
    names, weights = model
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    both = language.document_evidence(docs).unionByName(language.page_evidence(pages), allowMissingColumns=True)
    rows = both.withColumn("row", F.coalesce("doc_id", -1 - F.col("page_id"))).collect()
    wanted = plain_identify([(r.text, r.declared, r.host, r.suffix) for r in rows], names, weights)
    judged = language.identify(both, names, weights).withColumn("row", F.coalesce("doc_id", -1 - F.col("page_id")))
    got = {r.row: (r.language, round(r.certainty, 5), r.accepted) for r in judged.collect()}
    for r, w in zip(rows, wanted):
        assert got[r.row][::2] == w[::2] and abs(got[r.row][1] - w[1]) < 2e-5


def test_page_evidence(spark):
    html = '<!-- no --><HTML class="x" lang=de-AT><script>var a="<b>";</script><body>Guten <b>Tag</b></body></html>'
    df = spark.createDataFrame([(1, "https://u@www.a.example.de:80/x?y", html), (2, None, None), (3, "nonsense", "<html lang=''>x")], "page_id long, url string, html string")
    got = {r.page_id: (r.text.split(), r.declared, r.host, r.suffix) for r in language.page_evidence(df).collect()}
    assert got == {1: (["Guten", "Tag"], "de", "www.a.example.de", "de"), 2: ([], None, "", None), 3: (["x"], None, "", None)}


def test_evidence_moves_short_texts(spark, model):
    names, weights = model
    rows = [(i, "an", d, None, s) for i, (d, s) in enumerate([("fr", None), ("es", None), (None, "de"), ("DE-ch", "de")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string")
    got = {r.doc_id: r.language for r in language.identify(df, names, weights).collect()}
    assert got == {0: "fr", 1: "es", 2: "de", 3: "de"}


def test_odd_rows(odd, empty, model):
    got = language.identify(language.document_evidence(odd), *model)
    assert got.count() == odd.count()
    assert {r.accepted for r in got.where("doc_id in (2, 3)").collect()} == {False}
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns and {0, 1} <= {r.doc_id for r in kept.collect()}
    assert language.keep_identified(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert language.keep_identified(unlabelled).count() == 0


# --- paragraphs -----------------------------------------------------------------------------


def sentences(rng, words):
    out = []
    while len(out) < words:
        some = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(rng.integers(4, 14))]
        out += [*some[:-1], some[-1] + "."]
    return " ".join(out[:words])


def texts_without(df, spans):
    marks = {r.id: r.spans for r in spans.collect()}
    out = {}
    for r in df.collect():
        data, at, parts = (r.text or "").encode(), 0, []
        for s in marks.get(r.doc_id, []):
            parts.append(data[at : s.start])
            at = s.end
        out[r.doc_id] = b"".join([*parts, data[at:]]).decode()
    return out


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    passages = [sentences(rng, int(n)) for n in rng.integers(55, 120, 12)]
    rows, holds = [], defaultdict(list)
    for i in range(120):
        before, after = sentences(rng, int(rng.integers(20, 200))), sentences(rng, int(rng.integers(20, 200)))
        if i % 2:
            rows.append((i, f"{before}\n{after}"))
        else:
            p = (i // 2) % len(passages)
            holds[p].append(i)
            rows.append((i, f"{before} {passages[p]} {after}"))
    return spark.createDataFrame(rows, "doc_id long, text string"), passages, holds


def test_planted_passages(planted):
    df, passages, holds = planted
    left = texts_without(df, paragraphs.repeated_spans(df))
    whole = {r.doc_id: r.text for r in df.collect()}
    assert all(left[i] == whole[i] for i in whole if i % 2)
    lost = 0
    for p, ids in holds.items():
        assert left[min(ids)] == whole[min(ids)]
        for i in ids[1:]:
            cut = passages[p] not in left[i]
            lost += not cut
            begin = whole[i].index(passages[p])
            outside = whole[i][:begin] + whole[i][begin + len(passages[p]) :]
            assert Counter(left[i].split()) - Counter(whole[i].split()) == Counter()
            assert len(Counter(outside.split()) - Counter(left[i].split())) <= 1
    assert lost <= 1


def test_similar_lines_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for base in range(8):
        line = sentences(rng, 60).split()
        for v in range(12):
            other = list(line)
            for at in rng.choice(len(other), v % 4, replace=False):
                other[at] = f"new{v}x{at}"
            rows.append((len(rows), " ".join(other)))
    df = spark.createDataFrame(rows, "id long, text string").select("id", F.lit(0).cast("long").alias("twin"), F.col("text").cast("binary").alias("text")).cache()
    lines = df.mapInArrow(paragraphs._units, paragraphs._LINES)
    names = {r.id: r.line for r in lines.collect()}
    wanted = {
        tuple(sorted((names[i], names[j])))
        for i, a in rows for j, b in rows
        if names[i] != names[j] and paragraphs.jaccard(a.encode(), b.encode()) >= paragraphs.SIMILAR
    }
    from palaver.llm.components import components
    from tests.llm.test_text_operators import plain_classes

    found = {tuple(r) for r in paragraphs.similar_lines(df, lines).collect()}
    assert found <= wanted
    members = set(names.values())
    plain = plain_classes(wanted, members)
    got = {r.v: r.component for r in components(spark.createDataFrame(list(found), "a long, b long")).collect()}
    same = sum(got.get(m, m) == plain[m] for m in members)
    assert same >= 0.97 * len(members)


def test_repeated_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [int(p) for p in rng.choice([7, 7, 7, *range(40)], 30)]) for i in rng.integers(-9, 60, 200)]
    wanted = Counter()
    least = {}
    for i, pairs in rows:
        for p in pairs:
            least[p] = min(i, least.get(p, i))
    for i, pairs in rows:
        wanted.update((i, 0, p, 2 * p) for p in pairs if i > least[p])
    df = spark.createDataFrame([(i, 0, p, p, [2 * x for x in p]) for i, p in rows], "id long, twin long, pairs array<long>, pair_words array<long>, pair_bytes array<long>")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for parts in ("1", "13", "97"):  # with many ranges, one pair fills several
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert Counter(map(tuple, paragraphs.repeated_pairs(df).collect())) == wanted
        assert paragraphs.repeated_pairs(df.limit(0)).count() == 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_near_copy_of_a_line_goes(spark):
    rng = np.random.default_rng(9)
    line = sentences(rng, 90)
    words = line.split()
    changed = " ".join([*words[:40], "other", *words[41:]])
    df = spark.createDataFrame([(1, f"{sentences(rng, 30)}\n{line}"), (2, f"{changed}\n{sentences(rng, 30)}")], "doc_id long, text string")
    left = texts_without(df, paragraphs.repeated_spans(df))
    assert "other" not in left[2] and line in left[1]


def test_without_repeats(planted, odd, empty):
    df, _, _ = planted
    got = {r.doc_id: r.text for r in paragraphs.without_repeats(df).collect()}
    assert got == texts_without(df, paragraphs.repeated_spans(df))
    kept = paragraphs.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    assert texts[3, None] == 2 and texts[2, ""] == 2
    assert texts[0, "The cat sat on the mat. It was warm there, and the cat slept until noon."] == 2
    assert paragraphs.repeated_spans(empty).count() == 0 and paragraphs.without_repeats(empty).count() == 0


# --- pipeline -------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf, docs):
    rows = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, columns = {r.doc_id: r.text for r in rows.collect()}, rows.columns
        rows = step(spark, rows, sf).cache()
        after = {r.doc_id: r.text for r in rows.collect()}
        assert rows.columns == columns and set(after) <= set(before)
        if name != "substring_dedup":
            assert all(before[i] == t for i, t in after.items())
    assert len(after) > 0.8 * docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)
    whole = corpus_pipeline.run(spark, sf)
    shown = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "doc_tokens").collect()))
    assert [r[0] for r in shown(whole)] and Counter(r[0] for r in shown(whole)).keys() == set(after)
    assert sum(r[2] for r in shown(whole)) == sum(r[2] for r in shown(packed))


def test_pipeline_odd_rows(spark, odd, empty):
    for rows in (odd, empty):
        for _, step in corpus_pipeline.STAGES:
            rows = step(spark, rows, "")
            rows.collect()


def test_the_plan_grows_in_proportion_to_the_languages(spark, docs):
    def size(n):
        names = [f"l{i:03d}" for i in range(n)] + [language.UNKNOWN]
        rows = spark.createDataFrame([], "doc_id long, host string, suffix string, declared string, country string, likelihood array<double>, share array<double>, text_place int, worded boolean")
        judged = language.judge(rows, names, *language.smoothed_priors(rows, len(names)))
        return len(judged._jdf.queryExecution().optimizedPlan().toString())

    few, many = size(4), size(48)
    assert many < 14 * few and many < 60_000


def test_the_sample_is_drawn_by_share(spark, docs):
    """Above 2^20 times the sample's rows as below: a share, not a number of lots."""
    names, model = language.fit_text_model(docs, labelled_rows=10**11)
    assert len(names) > 2 and np.allclose(model[:-1], -np.log(language.CELLS), atol=0.02)  # next to no row is drawn of this table
    half = language.fit_text_model(docs, rows=10**11 // 2, labelled_rows=10**11)[1]
    whole = language.fit_text_model(docs, rows=10**11, labelled_rows=10**11)[1]
    assert not np.allclose(half, whole)  # some rows, not all


def test_only_the_most_frequent_labels_are_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    rows = [(i, "some text of words", "abc"[min(2, i % 5)]) for i in range(50)]
    names, _ = language.fit_text_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert names == ["a", "c", language.UNKNOWN]


def test_every_operator_has_a_query():
    names = set(queries.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))

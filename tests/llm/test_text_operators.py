"""Tokens, fingerprints, scores, shards and packing beside plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palaver.llm import ngram, packing, pieces, queries, shards, simhash
from palaver.llm.components import components
from palaver.session import stage

MODEL = P.path("piece_bpe_32k.model")
BYTES = queries.byte_vocabulary()


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- pieces ---------------------------------------------------------------------------------


def test_pieces_equal_the_library(odd, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for df in (odd, docs):
        texts = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        wanted = sorted(str((i, [*library.encode(t), 2], library.decode(library.encode(t)))) for i, t in texts)
        got = pieces.encode_pieces(df, MODEL, decoded=True)
        assert sorted(str((r.id, r.ids, r.decoded)) for r in got.collect()) == wanted


def test_pieces_of_random_strings():
    encoder, library = pieces.encoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = np.random.default_rng(3)
    known = list(encoder.ids)
    bits = [" ", "   ", "▁", "a", "th", "é", "漢", "\n", "\x00", "1", "😀", "st", ".", "\t"]
    for n in range(1500):
        text = "".join(rng.choice(bits if n % 2 else known, rng.integers(0, 25)))
        assert encoder.encode(text).tolist() == [*library.encode(text), 2]
    for text in ("a" * 5000, " " * 3000 + "x" + " " * 17, "ab" * 4000):
        assert encoder.encode(text).tolist() == [*library.encode(text), 2]


def test_pieces_of_a_word_are_found_once(monkeypatch):
    """What stands beside a word doesn't make it new, and no pair of pieces is merged in full to see whether it fits."""
    encoder, library = pieces.PieceEncoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    calls = Counter()
    for name in ("backtrack", "merge"):
        plain = getattr(encoder, name)
        monkeypatch.setattr(encoder, name, lambda *a, name=name, plain=plain: calls.update([name]) or plain(*a))
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abdehinorst"), 9)) for _ in range(200)]
    for mark in (".", ",", "!", ";\n", "###", "\x00", "漢", "😀"):
        text = " ".join(w + mark for w in words)
        assert encoder.encode(text).tolist() == [*library.encode(text), 2]
    assert calls["backtrack"] < 1.1 * len(words)
    assert calls["merge"] == 0


def test_pieces_fit_as_if_merged_in_full(monkeypatch):
    encoder = pieces.encoder(MODEL)
    rng = np.random.default_rng(4)
    for a, b in rng.choice(sorted(encoder.cut), (3000, 2)):
        assert encoder.compatible(a, b) == (encoder.merge(a + b) == [a, b])

    class Made:
        """A vocabulary of made-up pieces; some scores are equal, some better than those of the pieces inside, d alone is none."""

        def __init__(self, model_file):
            longer = {"".join(rng.choice(list("abcd"), rng.integers(2, 6))) for _ in range(30)}
            self.held = ["<0x00>", "a", "b", "c", *sorted(longer)]
            order = rng.permutation(len(self.held)) if rng.random() < 0.5 else np.array([len(p) for p in self.held]) * 40 + rng.permutation(len(self.held))
            self.scores = -(order // rng.integers(1, 4)).astype(float)

        def __getattr__(self, name):
            return {
                "get_piece_size": lambda: len(self.held), "id_to_piece": self.held.__getitem__, "piece_to_id": lambda p: 0,
                "get_score": lambda i: self.scores[i], "is_byte": lambda i: i == 0, "eos_id": lambda: 0,
            }.get(name, lambda i: False)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Made)
    ordered = 0
    for _ in range(60):
        encoder = pieces.PieceEncoder("")
        ordered += len(encoder.ends) - 3
        for a in encoder.cut:
            for b in encoder.cut:
                assert encoder.compatible(a, b) == (encoder.merge(a + b) == [a, b])
        assert encoder.encode("adb").tolist() == [0, 0, 0, 1, 0, 2, 0]  # as bytes, whatever pieces hold it
    assert ordered > 100


def test_pieces_of_texts_side_by_side(spark):
    """Texts that end or begin with blanks, are empty or lie across the blocks in which borders are looked up."""
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["a  ", "  a", " ", "", "   ", None, "▁", "▁▁", "x", "\n", "the " * 20_000, "  ", "ab" * 40_000, "", " z"]
    encoder = pieces.encoder(MODEL)
    ids, at = encoder.encode_all([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*library.encode(t or ""), 2] for t in texts]
    assert [len(x) for x in encoder.encode_all([])] == [0, 1]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.id: (r.ids, r.decoded) for r in pieces.encode_pieces(df, MODEL, decoded=True).collect()}
    assert got == {n: ([*library.encode(t or ""), 2], library.decode(library.encode(t or ""))) for n, t in enumerate(texts)}


def test_pieces_decode_round_trip(spark, docs, empty):
    coded = pieces.encode_pieces(docs, MODEL)
    decoded = {r.id: r.text for r in pieces.decode_pieces(coded, MODEL).collect()}
    assert decoded == {r.doc_id: r.text for r in docs.collect()}
    assert pieces.encode_pieces(empty, MODEL).count() == 0
    none = spark.createDataFrame([(1, None)], "id long, ids array<int>")
    assert rows(pieces.decode_pieces(none, MODEL)) == [(1, "")]


# --- near-duplicates ------------------------------------------------------------------------


def plain_fingerprint(text, shingle):
    words = (text or "").encode().lower().split()
    some = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_classes(links, members):
    root = {m: m for m in members}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {m: find(m) for m in members}


@pytest.mark.parametrize("shingle", [3, 5])
def test_simhash(spark, docs, shingle):
    one = docs.limit(1).collect()[0].text.split()
    near = [" ".join(one[:k] + ["changed"] + one[k + 1 :]) for k in range(0, min(60, len(one)), 3)]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate([*near, None, "", " \n"])], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(more)
    prints = {r.doc_id: plain_fingerprint(r.text, shingle) for r in df.collect()}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    classes = plain_classes(links, ids)
    got = {r.id: (r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_duplicates(df, shingle=shingle).collect()}
    assert got == {i: (prints[i], classes[i]) for i in ids}
    assert len(links) > 20
    kept = simhash.keep_first(df, shingle=shingle)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values()))


@pytest.mark.parametrize("radius", [1, 3])
def test_simhash_radius(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 62, 6)
    prints = {int(b) ^ sum(1 << int(x) for x in rng.choice(62, rng.integers(0, 6), replace=False)) for b in base for _ in range(25)}
    links = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= radius}
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    assert {tuple(r) for r in simhash.ball_links(df, radius).collect()} == links


def test_simhash_odd_rows(odd, empty):
    got = rows(simhash.near_duplicates(odd).select("id", "component_id"))
    assert len(got) == odd.count()
    assert {c for i, c in got if i in (0, 1)} == {0} and {c for i, c in got if i in (2, 3)} == {2}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(0) == 1 and 1 not in ids and 3 not in ids
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(200, 300)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    loose = [tuple(map(int, rng.integers(2000, 2100, 2))) for _ in range(70)]
    links = chain + star + loose + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    members = {x for a, b in links if a != b for x in (a, b)}
    assert dict(rows(components(df))) == plain_classes([x for x in links if x[0] != x[1]], members)
    assert components(df.where("false")).count() == 0


# --- scores ---------------------------------------------------------------------------------


def plain_base(texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in texts.items()}
    counts = Counter(w for i in texts if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    return {
        i: (held[i], len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[i]))
        for i in texts
    }


@pytest.mark.parametrize("chunk", [2_000, 2_000_000])
def test_scores(docs, chunk):
    got = {r.id: r for r in ngram.score_texts(docs, chunk_tokens=chunk).collect()}
    wanted = plain_base({r.doc_id: r.text for r in docs.collect()})
    assert set(got) == set(wanted)
    for i, (held, n, known, train, base) in wanted.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def dictionary_automaton(texts, held, order):
    """Scores of whole texts by dictionaries of n-grams, and held-out texts' sum; weights by leave-one-out, size by size."""
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in texts.items()}
    counts = Counter()
    for i, w in tokens.items():
        if not held[i]:
            counts.update((x,) for x in w)
            for size in range(2, order + 1):
                line = (None, *w)
                counts.update(line[k : k + size] for k in range(len(line) - size + 1))
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    place = lambda c: min(int(math.log2(max(c, 1))) // 3, ngram.CLASSES - 1)
    weights: dict[int, list[float]] = {}

    def kept(gram):
        if len(gram) == 1:
            return max(counts[gram], 1) / (n + v)
        before = counts[gram[:-1]] - 1
        x = weights[len(gram)][place(before)] if before else 0
        return x * (counts[gram] - 1) / max(before, 1) + (1 - x) * kept(gram[1:])

    for size in range(2, order + 1):
        fit = np.zeros((ngram.CLASSES, len(ngram.WEIGHTS)))
        for gram, c in counts.items():
            if len(gram) == size:
                before, lower = counts[gram[:-1]] - 1, kept(gram[1:])
                for g, x in enumerate(ngram.WEIGHTS):
                    x = x if before else 0
                    fit[place(before), g] += c * math.log10(x * (counts[gram] - 1) / max(before, 1) + (1 - x) * lower)
        weights[size] = [ngram.WEIGHTS[g] for g in fit.argmax(axis=1)]

    def p(history, word):
        if not history:
            return (counts[word,] + 1) / (n + v + 1)
        x = weights[len(history) + 1][place(counts[history])] if counts[history] else 0
        return x * counts[*history, word] / max(counts[history], 1) + (1 - x) * p(history[1:], word)

    scores = {}
    for i, w in tokens.items():
        line = (None, *w)
        scores[i] = sum(math.log10(p(line[max(0, k - order + 1) : k], line[k])) for k in range(1, len(line)))
    return scores


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_are_the_automatons(docs, order):
    """Scores of whole texts by plain dictionaries; chunks of many lanes and, for the default order, of few texts."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    wanted = dictionary_automaton(texts, held, order)
    got = {r.id: r.score for r in ngram.score_texts(docs, order=order, chunk_tokens=3_000 if order == 3 else ngram.CHUNK_TOKENS).collect()}
    assert set(got) == set(wanted)
    for i, score in wanted.items():
        assert math.isclose(got[i], score, rel_tol=1e-9)


def test_scores_in_many_buckets(docs, monkeypatch):
    """The same scores whether n-grams meet in one bucket or in many."""
    one = {r.id: r.score for r in ngram.score_texts(docs).collect()}
    monkeypatch.setattr(ngram, "BUCKET_KEYS", 1_000)
    many = {r.id: r.score for r in ngram.score_texts(docs, chunk_tokens=5_000).collect()}
    assert set(one) == set(many) and all(math.isclose(one[i], many[i], rel_tol=1e-9) for i in one)


def test_third_order_scores_held_out_texts_higher(docs):
    kept = lambda order: ngram.score_texts(docs, order=order).where("held_out").agg({"score": "sum"}).first()[0]
    assert kept(3) > kept(2)


def test_scores_odd_rows(odd, empty):
    got = rows(ngram.score_texts(odd).select("id", "n_tokens", "score"))
    assert len(got) == odd.count() and all(math.isfinite(s) for *_, s in got)
    assert {n for i, n, _ in got if i in (2, 3)} == {1}
    assert ngram.score_texts(empty).count() == 0


def test_word_hashes_are_distinct(docs):
    import pyarrow as pa

    words = sorted({w for r in docs.collect() for w in r.text.encode().lower().split()})
    hashes, lengths = ngram.token_hashes(pa.array([w.decode() for w in words]))
    assert (lengths == 2).all() and len(set(hashes.tolist())) == len(words) + 1


# --- shards ---------------------------------------------------------------------------------


def check_shards(df, placed, count=16):
    got = placed.toPandas()
    assert len(got) == df.count()
    sizes = df.select(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).toPandas().iloc[:, 0]
    assert sorted(got["size"]) == sorted(sizes)
    for _, one in got.groupby("shard"):
        assert sorted(one["slot"]) == list(range(len(one)))
    assert got["shard"].between(0, count - 1).all()
    return got


def test_shards(docs, odd, empty):
    got = check_shards(docs, shards.assign_shards(docs))
    want = {r.doc_id: zlib.crc32(r.text.encode()) for r in docs.collect()}
    assert dict(zip(got["id"], got["text_crc32"])) == want
    bytes_ = got.groupby("shard")["size"].sum().reindex(range(16), fill_value=0)
    assert bytes_.max() - bytes_.min() <= 2.1 * got["size"].max()
    check_shards(odd, shards.assign_shards(odd))
    assert shards.assign_shards(empty).count() == 0


def test_shards_split_a_crowded_key(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = check_shards(df, shards.assign_shards(df))
    bytes_ = got.groupby("shard")["size"].sum()
    assert len(bytes_) == 16 and bytes_.max() <= 1.02 * bytes_.mean()


def test_shards_keep_copies_together(spark):
    df = spark.range(6_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3_000).alias("text"))
    got = shards.assign_shards(df).groupBy("text_crc32").agg(F.countDistinct("shard").alias("n"))
    assert got.where("n > 1").count() == 0


def test_shards_write(spark, docs, tmp_path):
    shards.write_shards(docs, str(tmp_path / "out"), 4)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.count() == docs.count() and {r.shard for r in again.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_shards_write_every_record_once(spark, odd, tmp_path):
    shards.write_shards(odd, str(tmp_path / "out"), 3)
    again = spark.read.parquet(str(tmp_path / "out"))
    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    assert pairs(again) == pairs(odd) and again.where("slot is null").count() == 0


def test_shards_split_rows_that_are_equal_throughout(spark):
    """A third of the rows has one id and one text, another part null ids."""
    n = F.col("id")
    df = spark.range(0, 12_000, 1, 9).select(
        F.when(n % 3 == 0, 7).when(n % 3 == 1, n).cast("long").alias("doc_id"), F.when(n % 3 == 0, "same text").when(n % 3 == 1, F.concat(F.lit("t"), n)).otherwise("nameless").alias("text")
    )
    got = check_shards(df, shards.assign_shards(df))
    bytes_ = got.groupby("shard")["size"].sum()
    assert len(bytes_) == 16 and bytes_.max() <= 1.02 * bytes_.mean()
    rows = stage(shards._records(df, "doc_id", "text"), "records")
    cuts = shards.sample_splitters(rows, 64, 100_000, 32, seed=0)
    sizes = shards.with_range(rows, cuts).groupBy("range").count().collect()
    assert max(r["count"] for r in sizes) < 12_000 / 8


# --- packing --------------------------------------------------------------------------------


def unpacked(df, packed, length=1024):
    """Ids of each document put together again, and the tokens of each sequence; asserts the layout."""
    got = packed.toPandas().sort_values(["sequence_id", "offset"])
    at = got.groupby("sequence_id")["length"].cumsum() - got["length"]
    assert (at == got["offset"]).all() and (got["length"] > 0).all()
    sizes = got.groupby("sequence_id")["length"].sum()
    assert sizes.max() <= length
    texts = Counter()
    for r in got.sort_values(["id", "start"]).itertuples():
        texts[r.id] += r.length
    return got, sizes


def test_packing(docs):
    library = Tokenizer.from_file(BYTES[0])
    got, sizes = unpacked(docs, packing.pack(docs.repartition(2), BYTES))
    for r in docs.collect():
        own = got[got["id"] == r.doc_id].sort_values("start")
        ids = np.frombuffer(b"".join(own["ids"]), "<u4").tolist()
        assert ids == [*library.encode(r.text, add_special_tokens=False).ids, 0]
        assert (own["start"] == own["length"].cumsum() - own["length"]).all() and (own["doc_tokens"] == len(ids)).all()
    assert 1 - sizes.sum() / (1024 * len(sizes)) < 0.03


def test_packing_odd_rows(odd, empty):
    library = Tokenizer.from_file(BYTES[0])
    for stretch in (1, 1 << 18):
        got, _ = unpacked(odd, packing.pack(odd.coalesce(1), BYTES, stretch=stretch))
        total = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
        assert got["length"].sum() == total
    assert packing.pack(empty, BYTES).count() == 0


def test_best_cuts_are_best():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        at = np.cumsum(rng.integers(1, 5, n))
        penalty = rng.integers(0, 6, n)
        length = int(rng.integers(5, 14))
        cost = {0: 0}
        for a, p in zip(at.tolist(), penalty.tolist()):
            cost[a] = min(cost[b] + length - (a - b) + p for b in cost if a - length <= b < a)
        cuts = packing.best_cuts(at, penalty, length)
        assert all(0 < b - a <= length for a, b in zip([0, *cuts], cuts)) and cuts[-1] == at[-1]
        assert sum(length - (b - a) + penalty[at.tolist().index(b)] for a, b in zip([0, *cuts], cuts)) == cost[at[-1]]

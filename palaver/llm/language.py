"""Language identification by Bayesian fusion of evidence.

Evidence on a row: its text (a naive Bayes model of byte trigrams, fitted on a bounded sample of labelled rows), the
language its markup declares, the suffix of its address, and its host. The host's prior is the share of languages among
the texts of that host, smoothed towards the shares of its suffix, which are smoothed towards those of all rows; the
shares come from grouped sums over every row. Trigrams of one text are far from independent, so at most
``TEXT_EVIDENCE`` of them count, in proportion. A language ``und`` with equal trigrams stands for what is no language.

Null texts are empty. A text without a letter has no evidence of its own and is rejected, as is a row whose best
language is ``und`` or less certain than ``CERTAIN``. Null and unknown declarations, suffixes and hosts say nothing
(hosts that are null form one host). Equal posteriors go to the language that comes first by name. The languages are the
``LANGUAGES`` most frequent labels (ties by name); rows with other labels are not fitted on, and their labels are unknown declarations. Without labelled
rows every text is ``und``. Repeated rows are judged alike, rows of one id each by its own text. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import slices, text_buffer, text_column
from palaver.session import small_side, stage

#: Most labelled rows the text model is fitted on, its languages and cells, and trigrams of a text that count.
SAMPLE_ROWS, LANGUAGES, CELLS, TEXT_EVIDENCE = 20_000, 200, 1 << 15, 60
#: How often a declaration and a country's suffix are right, texts that a smoothing prior is worth, and certainty to accept.
DECLARED, SUFFIX, PRIOR_TEXTS, CERTAIN = 0.9, 0.8, 20.0, 0.6
UNKNOWN = "und"
#: Country suffixes and the language most used there.
SUFFIX_LANGUAGE = {
    "at": "de", "ch": "de", "de": "de", "li": "de", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es",
    "fr": "fr", "us": "en", "uk": "en", "au": "en", "ie": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt",
    "nl": "nl", "pl": "pl", "se": "sv", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko",
}


def trigram_cells(data: np.ndarray) -> np.ndarray:
    """The cell of the trigram that ends at each byte from the third on; A-Z count as a-z."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32) % CELLS


def _rows_of(at: np.ndarray) -> np.ndarray:
    """The row that each trigram lies in, -1 where it would reach over two."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.where(row[2:] == row[:-2], row[2:], -1)


def _count(batches):
    for batch in slices(batches, "text"):
        data, at = text_buffer(batch.column("text"))
        if len(data) < 3:
            continue
        row, cell = _rows_of(at), trigram_cells(data)
        names, label = np.unique(np.array(batch.column("label").to_pylist(), dtype=object).astype(str), return_inverse=True)
        keep = row >= 0
        table = np.bincount(label[row[keep]] * CELLS + cell[keep], minlength=len(names) * CELLS).reshape(len(names), CELLS)
        which, cells = np.nonzero(table)
        yield pa.RecordBatch.from_pydict(
            {"label": pa.array(names[which].tolist(), pa.string()), "cell": pa.array(cells, pa.int32()), "n": table[which, cells]}
        )


def fit_text_model(
    df: DataFrame, text: str = "text", label: str = "lang", rows: int = SAMPLE_ROWS, key: str = "doc_id", labelled_rows: int | None = None
) -> tuple[list[str], np.ndarray]:
    """Languages by name, and the log-probability of each trigram cell in each; fitted on about ``rows`` labelled rows.

    Rows are drawn by their id, so copies of a text are drawn one by one; those without an id are drawn by their text.
    ``labelled_rows`` is their number where it is known.
    """
    labelled = df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("string").alias("label"), text_column(df, text).alias("text"), F.col(key).alias("id")
    )
    found = labelled.where(F.col("label") != UNKNOWN).groupBy("label").agg(F.count("*").alias("n"))
    found = found.orderBy(F.desc("n"), "label").limit(LANGUAGES).collect()
    names = sorted(r["label"] for r in found)
    n = labelled_rows or sum(r["n"] for r in found)
    draw = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    some = labelled.where(F.col("label").isin(names) & (draw.cast("double") / 2.0**64 + 0.5 < rows / max(1, n))).select("label", "text")
    counts = some.mapInArrow(_count, "label string, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    counts = counts.toArrow()  # a row for each language and cell at most
    grid = np.full((len(names), CELLS), 0.5, np.float32)
    place = np.searchsorted(np.array(names, dtype=object), np.array(counts.column("label").to_pylist(), dtype=object)) if len(counts) else []
    grid[place, np.asarray(counts.column("cell"))] += np.asarray(counts.column("n"), dtype=np.float32)
    model = np.log(grid / grid.sum(axis=1, keepdims=True, dtype=np.float64)).astype(np.float32)
    return [*names, UNKNOWN], np.vstack([model, np.full((1, CELLS), -np.log(CELLS), np.float32)])


def text_likelihoods(df: DataFrame, model: np.ndarray, evidence: int = TEXT_EVIDENCE) -> DataFrame:
    """Adds what the text says and drops it.

    ``likelihood`` has a language's log-likelihood in each place, ``share`` its share of them, ``text_place`` is the
    greatest's place, and ``worded`` whether the text has letters.
    """
    kept = [c for c in df.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "text")
    model = model.astype(np.float32)

    def run(batches):
        for batch in slices(batches, "text"):
            data, at = text_buffer(batch.column("text"))
            n = batch.num_rows
            sums = np.zeros((n, len(model)))
            letters = np.zeros(n)
            if len(data) >= 3:
                row, cell = _rows_of(at), trigram_cells(data)
                wordy = ((data[2:] | 32) >= 97) & ((data[2:] | 32) <= 122) | (data[2:] >= 128)
                keep = np.flatnonzero((row >= 0) & wordy)
                letters = np.bincount(row[keep], minlength=n)
                for i, weights in enumerate(model):
                    sums[:, i] = np.bincount(row[keep], weights[cell[keep]], n)
            sums *= np.minimum(1.0, evidence / np.maximum(letters, 1))[:, None]
            powers = np.exp(sums - sums.max(axis=1, keepdims=True))
            ends = pa.array(np.arange(n + 1) * len(model), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (sums, powers / powers.sum(axis=1, keepdims=True))]
            more = [*lists, pa.array(sums.argmax(axis=1).astype(np.int32)), pa.array(letters > 0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + more, [*kept, "likelihood", "share", "text_place", "worded"]
            )

    more = "likelihood array<double>, share array<double>, text_place int, worded boolean"
    return df.mapInArrow(run, ", ".join(x for x in (schema, more) if x))


def evidence(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows (any keys, text, declared, host, suffix) in the form that is judged: unknown languages are null."""
    keys = [c for c in df.columns if c not in ("text", "declared", "host", "suffix")]
    declared = F.lower(F.substring_index(F.col("declared").cast("string"), "-", 1))
    suffix = F.lower(F.coalesce(F.col("suffix").cast("string"), F.lit("")))
    country = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    known = lambda c: F.when(c.isin(names[:-1]), c)
    rows = df.select(
        *keys, text_column(df, "text").alias("text"), declared.alias("declared"),
        F.lower(F.coalesce(F.col("host").cast("string"), F.lit(""))).alias("host"), suffix.alias("suffix"), country[suffix].alias("country"),
    )
    return rows.withColumns({"declared": known(F.col("declared")), "country": known(F.col("country"))})


def smoothed_priors(rows: DataFrame, n: int) -> tuple[DataFrame, list[float]]:
    """(host, suffix, prior) from rows (host, suffix, share, worded), and the prior of rows without either.

    The shares of a host's texts are smoothed towards its suffix's, and those towards all rows'.
    """
    sums = F.array(*[F.sum(F.col("share")[i]) for i in range(n)])
    hosts = stage(rows.where("worded").groupBy("host", "suffix").agg(sums.alias("sums")), "hosts")
    added = F.array(*[F.sum(F.col("sums")[i]) for i in range(n)])
    whole = np.array(hosts.agg(added.alias("sums")).first()["sums"], dtype=object)
    whole = np.array([x or 0.0 for x in whole], dtype=float) + 1.0
    whole = (whole / whole.sum()).tolist()

    def smoothed(own: str, towards: Column) -> Column:
        total = F.aggregate(own, F.lit(PRIOR_TEXTS), lambda a, x: a + x)
        return F.zip_with(own, towards, lambda x, y: (x + PRIOR_TEXTS * y) / total)

    suffixes = hosts.groupBy("suffix").agg(added.alias("near"))
    suffixes = stage(suffixes.select("suffix", smoothed("near", F.array(*map(F.lit, whole))).alias("near")), "suffixes")
    return stage(hosts.join(suffixes, "suffix").select("host", "suffix", smoothed("sums", F.col("near")).alias("prior")), "priors"), whole


def judge(rows: DataFrame, names: list[str], priors: DataFrame, whole: list[float]) -> DataFrame:
    """Adds language, certainty, text_language and accepted to rows that hold all evidence.

    Logarithms stay arrays with a place for each language, so the plan does not grow with them but for its constants.
    """
    keyed = rows.join(small_side(priors, priors.count(), 50_000), ["host", "suffix"], "left")
    places = F.array(*map(F.lit, names))

    def says(column: str, right: float) -> Column:
        other = float(np.log((1 - right) / max(1, len(names) - 2)))
        voice = lambda name: F.when(name == F.col(column), F.lit(float(np.log(right)))).otherwise(F.lit(other))
        return F.when(F.col(column).isNull(), F.array_repeat(F.lit(0.0), len(names))).otherwise(F.transform(places, voice))

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    prior = F.transform(F.coalesce("prior", F.array(*map(F.lit, whole))), lambda x: F.log(x))
    fused = add(add(add(F.col("likelihood"), says("declared", DECLARED)), says("country", SUFFIX)), prior)
    summed = keyed.withColumn("fused", fused).withColumn("top", F.array_max("fused"))
    share = 1 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    best = summed.withColumn("certainty", share).withColumn("language", F.get(places, F.array_position("fused", F.col("top")).cast("int") - 1))
    return best.withColumn("text_language", F.when(F.col("worded"), F.get(places, F.col("text_place"))).otherwise(F.lit(UNKNOWN))).withColumn(
        "accepted", F.col("worded") & (F.col("language") != UNKNOWN) & (F.col("certainty") >= CERTAIN)
    )


def identify(df: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """Judges rows (any keys, text, declared, host, suffix): the keys, language, certainty, text_language, accepted."""
    keys = [c for c in df.columns if c not in ("text", "declared", "host", "suffix")]
    rows = stage(text_likelihoods(evidence(df, names), model), "likelihoods")
    judged = judge(rows, names, *smoothed_priors(rows, len(names)))
    return judged.select(*keys, "language", "certainty", "text_language", "accepted")


def document_evidence(docs: DataFrame, *more: Column) -> DataFrame:
    """Documents as rows to judge: the source is the host, the language column the declaration, there is no address."""
    return docs.select(
        *more, F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("declared"),
        F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Web pages as rows to judge: text without markup, the language of the html tag, host and suffix of the address."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    host = F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(bare, "<[^>]*>", " ").alias("text"),
        F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1), F.lit("")).alias("declared"),
        host.alias("host"), F.when(host.contains("."), F.substring_index(host, ".", -1)).alias("suffix"),
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is accepted, with their own columns; every row is judged by its own text.

    The verdict goes along with the row, so nothing is joined by id: the texts are read once for the hosts' priors and once
    more to be judged.
    """
    names, model = fit_text_model(docs)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = document_evidence(docs, whole)
    shares = text_likelihoods(evidence(rows.drop("whole", "doc_id"), names).select("host", "suffix", "text"), model)
    priors = smoothed_priors(stage(shares.select("host", "suffix", "share", "worded"), "shares"), len(names))
    judged = judge(text_likelihoods(evidence(rows, names), model), names, *priors)
    return judged.where("accepted").select("whole.*")

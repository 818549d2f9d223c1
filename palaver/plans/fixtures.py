"""Shared views: the driver's tables in the shape of raw discussion data.

The SQL runs unchanged in Spark and DuckDB, but for ``{nan_first}`` and ``{inf_first}``. Every
view reads its whole source table. Awkward cases are planted: deleted authors, bots, bad
numbers, null titles, removed bodies, replies, orphans, one crowded thread that holds a third
of the documents, an null group of questions, NaN and infinite vector elements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

_TURN = "'s', cast(conv_id as string), '_', cast(turn as string)"
_LINK = (
    "case when mod(doc_id, 3) = 1 then 't3_s6_0' else concat('t3_s', "
    "cast(cast(floor(doc_id / 10) as bigint) as string), '_', cast(mod(doc_id, 2) as string)) end"
)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # Every turn of a conversation is a submission, its text the title.
    "raw_submissions": (
        ("conversations",),
        f"""
select concat({_TURN}) as id,
  case when mod(conv_id, 19) = 4 then null else text end as title,
  case when mod(conv_id, 11) = 3 then '[deleted]' when mod(conv_id, 13) = 5 then 'AutoModerator'
       else concat('src', cast(mod(conv_id, 20) as string), '_en_', cast(cast(floor(conv_id / 200) as bigint) as string))
  end as author,
  case when mod(conv_id, 17) = 7 then 'n/a' else concat(cast(1690000000 + conv_id * 3600 + turn * 60 as string), '.5') end as created_utc,
  case when mod(conv_id, 5) = 0 then 'true' when mod(conv_id, 5) = 1 then null else 'false' end as over_18,
  case when mod(conv_id, 23) = 6 then '-1.9e1' else cast(mod(conv_id * 13 + turn, 97) as string) end as score,
  cast(mod(conv_id, 7) as string) as num_comments
from {{conversations}}""",
    ),
    # Documents comment on the first two turns of conversations, ten to a conversation, but
    # for a third of them, which crowd into one thread.
    "raw_comments": (
        ("documents",),
        f"""
select concat('c', cast(doc_id as string)) as id,
  case when mod(doc_id, 23) = 0 then '[deleted]' when mod(doc_id, 29) = 0 then '[removed]' else text end as body,
  cast(mod(n_chars, 101) as string) as ups,
  case when mod(doc_id, 41) = 9 then '' else cast(mod(doc_id, 7) as string) end as downs,
  case when mod(doc_id, 43) = 8 then null else concat(cast(1700000000 + mod(doc_id * 37, 1000) as string), '.0') end as created_utc,
  case when mod(doc_id, 31) = 0 then '[deleted]' when mod(doc_id, 37) = 0 then 'AutoModerator'
       else concat(source, '_', lang, '_', cast(cast(floor(doc_id / 2000) as bigint) as string)) end as author,
  case when mod(doc_id, 7) = 2 then concat('t1_c', cast(doc_id - 1 as string)) else {_LINK} end as parent_id,
  {_LINK} as link_id
from {{documents}}""",
    ),
    # Model replies to titles: punctuation, sentences, non-ASCII letters, unreadable ones.
    "raw_completions": (
        ("conversations",),
        f"""
select concat({_TURN}) as id, text as title,
  case mod(conv_id + turn, 6) when 0 then ' Valid.' when 1 then 'It is INVALID!' when 2 then 'Valid or invalid'
       when 3 then 'unsure' when 4 then '**valid**' else 'Inválid' end as completion
from {{conversations}}""",
    ),
    # Ten labels by groups of 500 vectors make the questions; some have no question.
    "answer_vectors": (
        ("embeddings",),
        """
select vec_id,
  case when mod(vec_id, 83) = 11 then null
       else concat('q', cast(label as string), '_', cast(cast(floor(vec_id / 500) as bigint) as string)) end as question_id,
  concat('a', cast(mod(vec_id, 43) as string)) as author,
  case when mod(vec_id, 61) = 7 then {nan_first} when mod(vec_id, 97) = 5 then {inf_first} else embedding end as embedding
from {embeddings}""",
    ),
    # Vectors of comments; their mean per author is the style vector. Authors a40-a42 have none.
    "comment_vectors": (
        ("embeddings",),
        "select vec_id, concat('a', cast(mod(vec_id, 40) as string)) as author, embedding from {embeddings}",
    ),
    # Pages with one archive link appended to each, its ampersand escaped in some.
    "link_pages": (
        ("pages",),
        """
select page_id, concat(html, '<A class="x" HREF=" https://host.example/', case when mod(page_id, 3) = 0 then 'a&amp;b/' else '' end,
  'Sub', cast(mod(page_id, 10) as string),
  case when mod(page_id, 2) = 0 then '_submissions' else '_Comments' end, '.zst ">x</A>',
  '<!-- <a href="/Hidden_comments.zst">y</a> --><a href=/Plain', cast(page_id as string), '.zst>z</a>') as html
from {pages}""",
    ),
    # Lines of JSON: whole document texts, missing and repeated keys, null values, and lines that are not objects.
    "json_lines": (
        ("documents",),
        """
select doc_id, case
  when mod(doc_id, 17) = 3 then concat('{{bad ', cast(doc_id as string))
  when mod(doc_id, 17) = 5 then concat('[', cast(doc_id as string), ']')
  when mod(doc_id, 17) = 7 then concat('{{"author":null,"extra":{{"k":1}},"id":"c', cast(doc_id as string), '"}}')
  when mod(doc_id, 17) = 9 then concat('{{"ups":1,"id":"early","body":"late","id":"c', cast(doc_id as string), '","ups":null}}')
  else concat('{{"zzz":true,"body":"', replace(replace(text, '"', concat(chr(92), '"')), chr(10), concat(chr(92), 'n')), '","ups":', cast(n_chars as string),
    ',"score":', cast(doc_id as string), '.5,"id":"c', cast(doc_id as string), '"}}') end as value
from {documents}""",
    ),
}

_SPARK = {
    "nan_first": "concat(array(float('NaN')), slice(embedding, 2, array_size(embedding)))",
    "inf_first": "concat(array(float('Infinity')), slice(embedding, 2, array_size(embedding)))",
}
_DUCKDB = {
    "nan_first": "list_concat(['NaN'::float], embedding[2:])",
    "inf_first": "list_concat(['Infinity'::float], embedding[2:])",
}


def view_sql(name: str, sf_dir: str | None = None) -> str:
    """The view for DuckDB over views of the tables' own names, or for Spark over files in ``sf_dir``."""
    sources, sql = VIEWS[name]
    if sf_dir is None:
        return sql.format(**_DUCKDB, **{s: s for s in sources}).strip()
    return sql.format(**_SPARK, **{s: f"parquet.`{sf_dir}/{s}.parquet`" for s in sources}).strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared view over the tables in ``sf_dir``."""
    return spark.sql(view_sql(name, sf_dir))

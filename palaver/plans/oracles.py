"""The registered queries as DuckDB SQL, to check results against."""

from __future__ import annotations

from palaver.functions.labels import SYSTEM_PROMPT
from palaver.operators.clean import BOT_ACCOUNTS
from palaver.plans.fixtures import VIEWS, view_sql
from palaver.sources.manifest import EXCLUDED_NAMES

# Parameters of the registered queries, sized for the shared tables.
PARAMS = {
    "min_comments": 10,
    "style_min_chars": 255,
    "answer_min_chars": 250,
    "sample": 15,
    "examples": 5,
    "preview": 2,
    "comments_per_row": 100,
    "bodies_per_row": 20,
    "budget": 5000,
    "excluded": (*EXCLUDED_NAMES, "SUB3"),
    "width": 32,
}


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _long(col: str) -> str:
    return (
        # A cast reads more than plain decimals (nan, infinity, 1_000), but none of that consists of these characters alone.
        f"case when regexp_full_match(trim({col}), '[-+.0-9eE]+') then try_cast(trunc(try_cast(trim({col}) as double)) as bigint) end"
    )


def _cut(key: str, order: str, rows: int) -> str:
    """Which part of its key's ordered rows a row is in, parts being ``rows`` long."""
    return f"cast((row_number() over (partition by {key} order by {order}) - 1) // {rows} as int)"


_AUTHOR_OK = f"author <> '[deleted]' and author not in ({_names(BOT_ACCOUNTS)})"
# Attributes of an anchor one by one, as (name, value); the first href counts.
_ATTRIBUTE = r"""([^\s=>"''/]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)"""
_HREF = f"""list_filter(list_zip(regexp_extract_all(tag, '{_ATTRIBUTE}', 1), regexp_extract_all(tag, '{_ATTRIBUTE}', 2)),
              lambda a: lower(a[1]) = 'href')[1][2]"""

# Building blocks: name -> (blocks it needs, SQL).
_BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    **{name: ((), view_sql(name)) for name in VIEWS},
    "json_objects": (
        ("json_lines",),
        "select * from json_lines where case when json_valid(value) then json_type(value) = 'OBJECT' else false end",
    ),
    # Of a repeated key the last value counts.
    "json_members": (
        ("json_objects",),
        """select doc_id, e.key as k, arg_max(coalesce(e.value::varchar, 'null'), e.id) as v
          from json_objects, json_each(value) e group by all""",
    ),
    "subs": (
        ("raw_submissions",),
        f"""select id, title, author, {_long('created_utc')} as created_utc, coalesce(over_18 = 'true', false) as over_18,
          {_long('score')} as score, {_long('num_comments')} as num_comments from raw_submissions where {_AUTHOR_OK}""",
    ),
    "coms": (
        ("raw_comments",),
        f"""select id, body, {_long('ups')} as ups, {_long('downs')} as downs, {_long('created_utc')} as created_utc,
          author, parent_id, link_id,
          case when starts_with(link_id, 't3_') then substr(link_id, 4) else link_id end as link_id_clean
          from raw_comments where starts_with(parent_id, 't3_') and body <> '[deleted]' and body <> '[removed]' and {_AUTHOR_OK}""",
    ),
    "matched": (
        ("subs", "coms"),
        "select * from coms where link_id in (select concat('t3_', id) from subs)",
    ),
    "flat": (
        ("matched",),
        "select link_id_clean as question_id, id as comment_id, body, ups, downs, created_utc, author from matched",
    ),
    "threads": (
        ("subs", "matched"),
        f"""select s.*, coalesce(m.segment, 0) as segment, coalesce(m.n_comments, 0) as n_comments, m.comments, m.n_chars
          from subs s left join (
            select link_id_clean, segment, count(*) as n_comments, cast(sum(length(body)) as bigint) as n_chars,
              string_agg(concat(id, '|', coalesce(ups::varchar, '-'), '|', coalesce(downs::varchar, '-'), '|',
                coalesce(created_utc::varchar, '-'), '|', author, '|', md5(body)), ',' order by created_utc nulls first, id) as comments
            from (select *, {_cut('link_id_clean', 'created_utc nulls first, id', PARAMS['comments_per_row'])} as segment from matched)
            group by 1, 2) m on m.link_id_clean = s.id""",
    ),
    "sizes": (
        ("subs", "matched"),
        """select s.id, count(m.id) as n from subs s left join matched m on m.link_id_clean = s.id group by s.id""",
    ),
    "long_coms": (("flat",), f"select * from flat where length(body) >= {PARAMS['style_min_chars']} and author is not null"),
    "prolific": (
        ("long_coms",),
        f"select author, count(*) as n_comments from long_coms group by 1 having count(*) >= {PARAMS['min_comments']}",
    ),
    "prolific_coms": (("long_coms", "prolific"), "select * from long_coms where author in (select author from prolific)"),
    "parsed": (
        ("raw_completions",),
        r"""select id, title, completion, lower(trim(regexp_replace(completion, '[^\p{L}\p{N}_\s]', '', 'g'))) as cleaned
          from raw_completions""",
    ),
    "classified": (
        ("parsed",),
        """select id, title, case when contains(cleaned, 'invalid') then 'Invalid' else 'Valid' end as label
          from parsed where contains(cleaned, 'valid')""",
    ),
    "candidates": (
        ("flat", "classified", "prolific"),
        f"""select question_id, author, body, created_utc, comment_id from flat
          where length(body) >= {PARAMS['answer_min_chars']}
            and question_id in (select id from classified where label = 'Valid')
            and author in (select author from prolific)""",
    ),
    "oldest": (
        ("candidates",),
        """select question_id, author, body, created_utc, comment_id from candidates
          qualify row_number() over (partition by question_id, author order by created_utc nulls first, comment_id) = 1""",
    ),
    "styles": (
        ("comment_vectors",),
        """select author, list(v order by i) as style, any_value(n) as n from (
            select author, i, cast(avg(v) as float) as v, count(*) as n from (
              select author, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from comment_vectors)
            group by author, i) group by author""",
    ),
    "styled": (
        ("answer_vectors", "styles"),
        """select vec_id, question_id, author, list_transform(a, lambda x: x / na) as u, list_transform(s, lambda x: x / ns) as w
          from (select *, greatest(sqrt(list_sum(list_transform(a, lambda x: x * x))), 1e-8) as na,
                  greatest(sqrt(list_sum(list_transform(s, lambda x: x * x))), 1e-8) as ns
                from (select vec_id, question_id, author,
                        list_transform(embedding, lambda x: case when isnan(x) then 0.0::double else x::double end) as a,
                        list_transform(style, lambda x: case when isnan(x) then 0.0::double else x::double end) as s
                      from answer_vectors join styles using (author)))""",
    ),
    "all_pairs": (
        ("styled",),
        """select a.question_id, list_dot_product(a.u, b.u) as x, list_dot_product(a.w, b.w) as y
          from styled a join styled b on a.question_id is not distinct from b.question_id and a.vec_id < b.vec_id""",
    ),
    "pairs": (("all_pairs",), "select * from all_pairs where isfinite(x) and isfinite(y)"),
    "extent": (
        ("pairs",),
        """select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, avg(x) as mx, avg(y) as my, var_samp(x) as vx,
          var_samp(y) as vy, covar_samp(x, y) as c, count(*) as n from pairs""",
    ),
    "fit": (
        ("extent",),
        "select *, c / sqrt(vx * vy) as r, c / vx as slope, my - c / vx * mx as intercept from extent",
    ),
}


def _compose(needs: tuple[str, ...], select: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in _BLOCKS[name][0]:
                visit(need)
            order.append(name)

    for need in needs:
        visit(need)
    head = ", ".join(f"{name} as materialized ({_BLOCKS[name][1]})" for name in order)
    return f"with {head} {select}" if head else select


_SLOT = (
    f"('0x' || substr(md5(w), 1, 8))::bigint % {PARAMS['width']} as dim, "
    "case when ('0x' || substr(md5(w), 9, 2))::bigint % 2 = 0 then 1 else -1 end as sign"
)
_DIMS = f"range({PARAMS['width']})"

_REPORT_VALUES = r"""
meta as (select count(*) as n, strftime(make_timestamp(min(created_utc) * 1000000), '%Y-%m-%d %H:%M:%S') as lo,
  strftime(make_timestamp(max(created_utc) * 1000000), '%Y-%m-%d %H:%M:%S') as hi, count(*) filter (over_18) as nsfw,
  avg(length(title)) as tl, avg(score) as sm, median(score) as smed from subs),
cnt as (select avg(n) as m, stddev_samp(n) as s, median(n) as p50, max(n) as mx,
  list_sort(list(n))[cast(floor((count(*) - 1) * 0.01 + 0.5) as bigint) + 1] as p01,
  list_sort(list(n))[cast(floor((count(*) - 1) * 0.99 + 0.5) as bigint) + 1] as p99 from sizes),
body as (select avg(length(body)) as bl, avg(ups) as u, avg(downs) as d from flat),
au as (select count(*) filter (a) as na, count(*) filter (b) as nb, count(*) as nu, count(*) filter (a and b) as ni from (
  select author, bool_or(s) as a, bool_or(not s) as b from (
    select author, true as s from subs union all select author, false from flat) where author is not null group by author)),
vals as (
  select 0 as line_no, 'General Metadata' as section, 'Total Submissions' as label, format('{:,}', n) as value from meta
  union all select 1, 'General Metadata', 'Date Range Start', lo from meta
  union all select 2, 'General Metadata', 'Date Range End', hi from meta
  union all select 3, 'General Metadata', 'NSFW Submissions', format('{:,} ({:.2f}%)', nsfw, nsfw / n * 100) from meta
  union all select 100, 'Comments per Submission (Top-Level)', 'Mean Comments per Sub', format('{:.4f}', m) from cnt
  union all select 101, 'Comments per Submission (Top-Level)', 'Std Dev Comments', format('{:.4f}', s) from cnt
  union all select 102, 'Comments per Submission (Top-Level)', '1st Percentile (p1)', format('{:.0f}', p01::double) from cnt
  union all select 103, 'Comments per Submission (Top-Level)', 'Median (p50)', format('{:.0f}', p50::double) from cnt
  union all select 104, 'Comments per Submission (Top-Level)', '99th Percentile (p99)', format('{:.0f}', p99::double) from cnt
  union all select 105, 'Comments per Submission (Top-Level)', 'Max Comments in one Sub', format('{:.0f}', mx::double) from cnt
  union all select 200, 'Content Analysis (Lengths & Scores)', 'Avg Submission Title Length', format('{:.2f} chars', tl) from meta
  union all select 201, 'Content Analysis (Lengths & Scores)', 'Avg Submission Score', format('{:.2f}', sm) from meta
  union all select 202, 'Content Analysis (Lengths & Scores)', 'Median Submission Score', format('{:.0f}', smed::double) from meta
  union all select 210, 'Content Analysis (Lengths & Scores)', 'Avg Comment Body Length', format('{:.2f} chars', bl) from body
  union all select 211, 'Content Analysis (Lengths & Scores)', 'Avg Comment Upvotes', format('{:.2f}', u) from body
  union all select 212, 'Content Analysis (Lengths & Scores)', 'Avg Comment Downvotes', format('{:.2f}', d) from body
  union all select 300, 'Author Analysis', 'Unique Submission Authors', format('{:,}', na) from au
  union all select 301, 'Author Analysis', 'Unique Comment Authors', format('{:,}', nb) from au
  union all select 302, 'Author Analysis', 'Total Unique Authors (Union)', format('{:,}', nu) from au
  union all select 303, 'Author Analysis', 'Authors in Both (Intersection)', format('{:,}', ni) from au
  union all select 304, 'Author Analysis', '% Sub Authors who also Commented', format('{:.2f}%', ni / na * 100) from au)"""


def _long_vector(source: str, keys: str, vec: str) -> str:
    return (
        f"select {keys}, generate_subscripts({vec}, 1) - 1 as dim, unnest({vec}) as raw from {source}"
    )


_SELECTS: dict[str, tuple[tuple[str, ...], str]] = {
    "clean_submissions": (("subs",), "select * from subs"),
    "clean_comments": (("coms",), "select * from coms"),
    "matched_comments": (("matched",), "select * from matched"),
    "assemble_threads": (("threads",), "select * from threads"),
    "thread_preview": (
        ("threads",),
        f"select id, title, segment, n_comments, comments from threads order by id, segment limit {PARAMS['preview']}",
    ),
    "explode_comments": (
        ("subs", "flat"),
        """select s.id as question_id, comment_id, body, ups, downs, f.created_utc, f.author
          from subs s left join flat f on f.question_id = s.id""",
    ),
    "general_metadata": (
        ("subs",),
        """select count(*) as n_submissions, min(created_utc) as min_ts, max(created_utc) as max_ts,
          count(*) filter (over_18) as n_nsfw, strftime(make_timestamp(min(created_utc) * 1000000), '%Y-%m-%d %H:%M:%S') as date_start,
          strftime(make_timestamp(max(created_utc) * 1000000), '%Y-%m-%d %H:%M:%S') as date_end,
          round(count(*) filter (over_18) / count(*), 6) as nsfw_share from subs""",
    ),
    "comment_count_distribution": (
        ("sizes",),
        """select round(avg(n), 6) as count_mean, round(stddev_samp(n), 6) as count_std, max(n) as count_max,
          cast(list_sort(list(n))[cast(floor((count(*) - 1) * 0.01 + 0.5) as bigint) + 1] as double) as p01,
          cast(median(n) as double) as p50,
          cast(list_sort(list(n))[cast(floor((count(*) - 1) * 0.99 + 0.5) as bigint) + 1] as double) as p99 from sizes""",
    ),
    "submission_content_stats": (
        ("subs",),
        """select round(avg(length(title)), 6) as title_len_mean, round(avg(score), 6) as score_mean,
          cast(median(score) as double) as score_median from subs""",
    ),
    "comment_content_stats": (
        ("flat",),
        "select round(avg(length(body)), 6) as body_len_mean, round(avg(ups), 6) as ups_mean, round(avg(downs), 6) as downs_mean from flat",
    ),
    "author_overlap": (
        ("subs", "flat"),
        """select count(*) filter (a) as n_submission_authors, count(*) filter (b) as n_comment_authors, count(*) as n_union,
          count(*) filter (a and b) as n_both, round(count(*) filter (a and b) / count(*) filter (a), 6) as share_both from (
            select author, bool_or(s) as a, bool_or(not s) as b from (
              select author, true as s from subs union all select author, false from flat) where author is not null group by author)""",
    ),
    "author_overlap_sketch": (
        ("subs", "flat"),
        """select unnest(['n_submission_authors', 'n_comment_authors', 'n_union', 'n_both']) as measure,
          unnest([a, b, u, a + b - u]) as n, true as within from (
            select (select count(distinct author) from subs) as a, (select count(distinct author) from flat) as b,
              (select count(*) from (select author from subs union select author from flat) where author is not null) as u)""",
    ),
    "author_union": (("subs", "flat"), "select author from subs union select author from flat"),
    "author_intersection": (("subs", "flat"), "select author from subs intersect select author from flat"),
    "prolific_authors": (("prolific",), "select author, n_comments from prolific"),
    "author_bodies": (
        ("prolific_coms",),
        f"""select author, segment, count(*) as n_bodies, string_agg(md5(body), ',' order by comment_id) as bodies from (
            select *, {_cut('author', 'comment_id', PARAMS['bodies_per_row'])} as segment from prolific_coms) group by 1, 2""",
    ),
    "valid_questions": (("classified",), "select distinct id from classified where label = 'Valid'"),
    "answer_candidates": (("candidates",), "select * from candidates"),
    "oldest_answer": (("oldest",), "select * from oldest"),
    "render_prompts": (
        ("subs",),
        f"""select id, p.role, p.content from (
            select id, unnest([{{'role': 'system', 'content': '{SYSTEM_PROMPT.replace("'", "''")}'}},
              {{'role': 'user', 'content': concat('Question: "', title, '"')}}]) as p from subs where title is not null)""",
    ),
    "parse_labels": (
        ("parsed",),
        """select id, completion, case when contains(cleaned, 'invalid') then 'Invalid'
          when contains(cleaned, 'valid') then 'Valid' end as label from parsed""",
    ),
    "classify_titles": (
        ("subs",),
        """select id, title, label from (select id, title, case when contains(lower(title), 'the') then 'Valid'
            when contains(lower(title), 'und') then 'Invalid' when contains(lower(title), 'eau') then 'Invalid' end as label
          from subs where title is not null) where label is not null""",
    ),
    "label_distribution": (
        ("classified",),
        """select label, count(*) as n, round(count(*) / (select count(*) from classified), 6) as share,
          (select count(*) from classified) as total,
          (select round(count(*) filter (label = 'Valid') / count(*), 6) from classified) as valid_share,
          (select round(1 - count(*) filter (label = 'Valid') / count(*), 6) from classified) as invalid_share
          from classified group by label order by label""",
    ),
    "label_examples": (
        ("classified",),
        f"""select id, title, label from classified
          qualify row_number() over (partition by label order by md5(concat('42:', id)), id) <= {PARAMS['examples']}""",
    ),
    "sample_titles": (
        ("subs",),
        f"select id, title from subs where title is not null order by md5(concat('42:', id)), id limit {PARAMS['sample']}",
    ),
    "clean_vectors": (
        ("answer_vectors",),
        f"""select vec_id, dim, case when isnan(raw) then 0 when isinf(raw) then 999 else round(raw::double, 6) end as value
          from ({_long_vector('answer_vectors', 'vec_id', 'embedding')})""",
    ),
    "normalize_vectors": (
        (),
        f"""select vec_id, dim, round(raw, 6) as value from ({_long_vector(
            '(select vec_id, list_transform(d, lambda x: x / greatest(sqrt(list_sum(list_transform(d, lambda y: y * y))), 1e-8)) as u '
            'from (select vec_id, list_transform(embedding, lambda x: x::double) as d from embeddings))', 'vec_id', 'u')})""",
    ),
    "author_style_vectors": (
        ("styles",),
        f"""select author, n as num_comments_used, dim, round(raw::double, 6) as value
          from ({_long_vector('styles', 'author, n', 'style')})""",
    ),
    "vector_table_schema": (
        ("styles",),
        """select author, n as num_comments_used, len(style) as width, 'array<float>' as embedding_type, 'int' as count_type,
          round(list_sum(list_transform(style, lambda x: x::double)), 5) as total from styles""",
    ),
    "embed_comments": (
        ("prolific_coms",),
        f"""select author, num_comments_used, dim, round(cast(coalesce(s, 0) / num_comments_used as float)::double, 6) as value from (
            select author, count(*) as num_comments_used, unnest({_DIMS}) as dim from prolific_coms group by author)
          left join (select author, dim, sum(sign) as s from (select author, {_SLOT} from (
              select author, unnest(string_split(body, ' ')) as w from prolific_coms) where w <> '') group by 1, 2) using (author, dim)""",
    ),
    "embed_answers": (
        ("oldest",),
        f"""select question_id, author, dim, round(cast(coalesce(s, 0) / greatest(sqrt(sum(coalesce(s, 0) * coalesce(s, 0)) over (partition by question_id, author)), 1e-12) as float)::double, 5) as value
          from (select question_id, author, unnest({_DIMS}) as dim from oldest)
          left join (select question_id, author, dim, sum(sign) as s from (select question_id, author, {_SLOT} from (
              select question_id, author, unnest(string_split(body, ' ')) as w from oldest) where w <> '') group by 1, 2, 3)
          using (question_id, author, dim)""",
    ),
    "pair_budget": (
        ("styled",),
        f"""select question_id, n, n_finite, pairs, finite_pairs, pairs_before from (
            select *, n * (n - 1) // 2 as pairs, n_finite * (n_finite - 1) // 2 as finite_pairs,
              cast(coalesce(sum(n * (n - 1) // 2) over (order by question_id nulls first rows between unbounded preceding and 1 preceding), 0) as bigint) as pairs_before
            from (select question_id, count(*) as n, count(*) filter (isfinite(list_sum(u)) and isfinite(list_sum(w))) as n_finite
                  from styled group by 1 having count(*) >= 2)) where pairs_before < {PARAMS['budget']}""",
    ),
    "pair_quality": (
        ("all_pairs",),
        """select count(*) as n_pairs, count(*) filter (isfinite(x) and isfinite(y)) as n_finite,
          count(*) filter (not (isfinite(x) and isfinite(y))) as n_removed from all_pairs""",
    ),
    "pair_similarity": (
        ("pairs",),
        """select question_id, count(*) as pairs, round(sum(x), 3) as sum_x, round(sum(y), 3) as sum_y, round(sum(x * x), 3) as sum_xx,
          round(sum(y * y), 3) as sum_yy, round(sum(x * y), 3) as sum_xy, round(min(x), 6) as min_x, round(max(x), 6) as max_x,
          round(min(y), 6) as min_y, round(max(y), 6) as max_y from pairs group by 1""",
    ),
    "similarity_correlation": (
        ("fit",),
        """select n as n_pairs, n >= 100 as sufficient, round(r, 6) as r, round(slope, 6) as slope, round(intercept, 6) as intercept,
          round(r * r, 6) as r2, round((select 2 * exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) / sqrt(pi()) * h * sum(pow(cos(a + (k + 0.5) * h), n - 3))
            from (select n, a, (pi() / 2 - a) / 400000 as h, unnest(range(400000)) as k from (
              select n, atan(abs(r) / sqrt(1 - r * r)) as a from fit)) group by n, h), 6) as p_value from fit""",
    ),
    "confidence_ellipse": (
        ("fit",),
        """select s as n_std, round(mx, 6) as mean_x, round(my, 6) as mean_y, round(sqrt(1 + r), 6) as radius_x,
          round(sqrt(1 - r), 6) as radius_y, round(sqrt(vx) * s, 6) as scale_x, round(sqrt(vy) * s, 6) as scale_y, 45.0::double as angle
          from fit, (select unnest([1.0::double, 2.0, 3.0]) as s)""",
    ),
    "regression_grid": (
        ("fit",),
        """select k, round(x, 6) as x, round(intercept + slope * x, 6) as y_hat from (
            select *, x0 + (x1 - x0) * k / 99 as x from fit, (select unnest(range(100))::int as k))""",
    ),
    "marginal_histograms": (
        ("pairs", "extent"),
        """select axis, bin, round(lo + (hi - lo) * bin / 50, 6) as lo, round(lo + (hi - lo) * (bin + 1) / 50, 6) as hi, coalesce(n, 0) as n
          from (select axis, lo, hi, unnest(range(50))::int as bin from (
              select 'x' as axis, x0 as lo, x1 as hi from extent union all select 'y', y0, y1 from extent))
          left join (select axis, bin, count(*) as n from (
              select 'x' as axis, cast(least(floor((x - x0) / (x1 - x0) * 50), 49) as int) as bin from pairs, extent
              union all select 'y', cast(least(floor((y - y0) / (y1 - y0) * 50), 49) as int) from pairs, extent) group by 1, 2)
          using (axis, bin)""",
    ),
    "hexbin_density": (
        ("pairs", "extent"),
        """select ci as cell_i, cj as cell_j, round(ci * sx + xa, 6) as x, round(cj * sy + y0, 6) as y, count(*) as n,
            round(log10(count(*)), 6) as log10_n from (
          select sx, sy, xa, y0, case when near then round_even(u, 0) else floor(u) + 0.5 end as ci,
            case when near then round_even(v, 0) else floor(v) + 0.5 end as cj from (
            select *, pow(u - round_even(u, 0), 2) + 3 * pow(v - round_even(v, 0), 2)
              < pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) as near from (
              select *, (x - xa) / sx as u, (y - y0) / sy as v from (
                select x, y, y0, x0 - 1e-9 * (x1 - x0) as xa, (x1 - x0) * (1 + 2e-9) / 60 as sx, (y1 - y0) / 34 as sy from pairs, extent))))
          group by ci, cj, sx, sy, xa, y0""",
    ),
    "jsonl_scan": (
        ("json_members",),
        """select max(case when k = 'id' then json_extract_string(v, '$') end) as id, max(case when k = 'body' then json_extract_string(v, '$') end) as body,
          max(case when k = 'author' then json_extract_string(v, '$') end) as author, max(case when k = 'ups' then json_extract_string(v, '$') end) as ups,
          max(case when k = 'score' then json_extract_string(v, '$') end) as score from json_members group by doc_id""",
    ),
    "json_key_projection": (
        ("json_members",),
        """select doc_id, concat('{', string_agg(concat('"', k, '":', v), ',' order by k), '}') as value from json_members
          where k in ('id', 'body', 'ups', 'score', 'author', 'missing') group by doc_id""",
    ),
    "link_manifest": (
        ("link_pages",),
        rf"""select page_id, href, lower(regexp_extract(href, '(?i)^.*/([^/]+)_(submissions|comments)\.zst$', 1)) as name,
            regexp_extract(href, '(?i)^.*/([^/]+)_(submissions|comments)\.zst$', 2) as kind from (
          select page_id, trim(replace(replace(replace(replace(replace(
              regexp_replace(raw, '^["'']|["'']$', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) as href
          from (select page_id, {_HREF} as raw
            from (select page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
              '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<a(\s(?:"[^"]*"|''[^'']*''|[^>"''])*)', 1)) as tag from link_pages)))
          where regexp_matches(href, '(?i)^.*/([^/]+)_(submissions|comments)\.zst$')
            and lower(regexp_extract(href, '(?i)^.*/([^/]+)_(submissions|comments)\.zst$', 1)) not in ({_names(n.lower() for n in PARAMS['excluded'])})""",
    ),
    "parquet_projection": ((), "select doc_id, lang, n_chars from documents"),
    "arrow_ipc_roundtrip": (
        ("threads",),
        """select id, title, author, created_utc, over_18, score, num_comments, segment, n_comments,
          coalesce(n_chars, 0) as n_chars, comments from threads""",
    ),
}


def oracle_sql() -> dict[str, str]:
    out = {name: _compose(needs, select) for name, (needs, select) in _SELECTS.items()}
    blocks = _compose(("subs", "flat", "sizes"), "")
    out["thread_report"] = (
        blocks.rstrip()
        + ","
        + _REPORT_VALUES
        + """ select line_no, 1 as part, printf('%-40s : %s', label, value) as line from vals
          union all select min(line_no), -1, '' from vals group by section
          union all select min(line_no), 0, concat(repeat('=', 20), ' ', section, ' ', repeat('=', 20)) from vals group by section"""
    )
    needs, links = _SELECTS["link_manifest"]
    out["manifest_anti_join"] = _compose(
        needs, f"select * from ({links}) where name not in (select name from ({links}) where mod(page_id, 5) = 0)"
    )
    return out

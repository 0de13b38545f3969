"""ANSI SQL counterparts of the registered queries, for cross-checking in another engine."""

from __future__ import annotations

from ..operators.language import TOP
from ..operators.resampling import POISSON_BOUNDS
from ..params import K_HEADLINE

# Shared views. Each query takes only the ones it needs, in this order.
VIEWS = {
    "raw_edges": (
        [],
        """SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey) * 100 + CAST(trunc(l_quantity) AS BIGINT) AS citationid,
  o_custkey AS citingcorpusid, l_partkey AS citedcorpusid, l_discount >= 0.05 AS isinfluential,
  CASE WHEN l_linestatus <> 'O' THEN [l_returnflag, CAST(l_linenumber AS VARCHAR)] END AS contexts,
  CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL
       WHEN l_linenumber >= 4 THEN [[CASE l_returnflag WHEN 'A' THEN 'background' WHEN 'N' THEN 'methodology' ELSE 'result' END],
                                    NULL, ['background', NULL, '']]
       ELSE [[CASE l_returnflag WHEN 'A' THEN 'background' WHEN 'N' THEN 'methodology' ELSE 'result' END]] END AS intents
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "cited_papers": (
        ["raw_edges"],
        """SELECT p_partkey AS corpusid,
  CASE WHEN p_type <> 'ECONOMY' THEN p_type || '-' || p_partkey END AS acl_id, p_name AS title,
  ['A' || p_size, p_brand] AS authors, CAST(1985 + floor(p_size / 4.0) AS INTEGER) AS year, p_brand AS venue,
  ['F' || p_size, p_type] AS s2fieldsofstudy, n_all AS citationcount, n_infl AS influentialcitationcount
FROM part LEFT JOIN (SELECT citedcorpusid, count(*) AS n_all, count(*) FILTER (WHERE isinfluential) AS n_infl
                     FROM raw_edges GROUP BY 1) ON p_partkey = citedcorpusid""",
    ),
    "citing_papers": (
        [],
        """SELECT c_custkey AS corpusid, c_name AS title, ['A' || c_nationkey, c_name] AS authors,
  year(first_date) AS year, CASE WHEN c_acctbal >= 0 THEN strftime(first_date, '%Y-%m-%d') END AS publicationdate,
  c_mktsegment AS venue, n_orders AS citationcount, ['F' || c_nationkey, c_mktsegment] AS s2fieldsofstudy
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_date, count(*) AS n_orders
                         FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
    ),
    "seeds": (
        ["cited_papers"],
        """SELECT p.*, text AS abstract FROM cited_papers p JOIN documents ON doc_id = corpusid
WHERE acl_id IS NOT NULL AND text IS NOT NULL""",
    ),
    # One view per thing an edge keeps: whether it exists, its first known contexts, its first known intents.
    "seed_links": (
        ["raw_edges", "seeds"],
        """SELECT r.* FROM raw_edges r SEMI JOIN seeds s ON r.citedcorpusid = s.corpusid WHERE r.citingcorpusid IS NOT NULL""",
    ),
    "known_contexts": (
        ["seed_links"],
        """SELECT citedcorpusid, citingcorpusid, contexts,
  row_number() OVER (PARTITION BY citedcorpusid, citingcorpusid ORDER BY citationid NULLS LAST, contexts) AS place
FROM seed_links WHERE contexts IS NOT NULL""",
    ),
    "known_intents": (
        ["seed_links"],
        """SELECT citedcorpusid, citingcorpusid, intents,
  row_number() OVER (PARTITION BY citedcorpusid, citingcorpusid ORDER BY citationid NULLS LAST, intents) AS place
FROM seed_links WHERE intents IS NOT NULL""",
    ),
    "edges": (
        ["seed_links", "known_contexts", "known_intents"],
        """SELECT links.citedcorpusid, links.citingcorpusid, links.isinfluential, k.contexts, n.intents
FROM (SELECT citedcorpusid, citingcorpusid, max(isinfluential) AS isinfluential FROM seed_links GROUP BY ALL) links
LEFT JOIN known_contexts k ON k.place = 1 AND k.citedcorpusid = links.citedcorpusid AND k.citingcorpusid = links.citingcorpusid
LEFT JOIN known_intents n ON n.place = 1 AND n.citedcorpusid = links.citedcorpusid AND n.citingcorpusid = links.citingcorpusid""",
    ),
    "citers": (
        ["edges", "citing_papers"],
        """SELECT p.*, text AS abstract, lang,
  CASE WHEN venue IN ('BUILDING', 'MACHINERY') THEN 'C-' || corpusid END AS acl_id
FROM citing_papers p LEFT JOIN documents ON doc_id = corpusid
WHERE corpusid IN (SELECT citingcorpusid FROM edges)""",
    ),
    "thresholds": (
        ["cited_papers"],
        """SELECT year, quantile_disc(coalesce(influentialcitationcount, 0), 0.5) AS floor,
  quantile_disc(coalesce(influentialcitationcount, 0), 0.99) AS cap
FROM cited_papers WHERE acl_id IS NOT NULL AND year IS NOT NULL GROUP BY 1""",
    ),
    "labelled": (
        ["edges"],
        """SELECT *, list_sort(list_distinct(list_filter(flatten(list_filter(coalesce(intents, []), lambda l: l IS NOT NULL)),
  lambda x: x IS NOT NULL AND x <> ''))) AS flat FROM edges""",
    ),
    # A pair is a usable seed, a usable citer and a link between them that fits both.
    "usable_seeds": (
        ["seeds", "thresholds"],
        """SELECT corpusid AS seed_id, p.year AS seed_year, authors AS seed_authors,
  floor IS NOT NULL AND icc >= floor AND icc < coalesce(cap, icc + 1) AS banded
FROM (SELECT *, coalesce(influentialcitationcount, 0) AS icc FROM seeds) p LEFT JOIN thresholds ON thresholds.year = p.year
WHERE p.year IS NOT NULL AND length(abstract) >= 200 AND length(abstract) <= 5000""",
    ),
    "usable_citers": (
        ["citers"],
        """SELECT corpusid AS citer_id, year AS citer_year, authors AS citer_authors FROM citers
WHERE year IS NOT NULL AND length(abstract) >= 200 AND length(abstract) <= 5000""",
    ),
    "base_pairs": (
        ["labelled", "usable_seeds", "usable_citers"],
        """SELECT seed_id, citer_id, isinfluential, flat, banded
FROM usable_seeds JOIN labelled ON citedcorpusid = seed_id JOIN usable_citers ON citingcorpusid = citer_id
WHERE citer_id <> seed_id AND citer_year >= seed_year
  AND len(list_intersect(coalesce(citer_authors, []), coalesce(seed_authors, []))) = 0""",
    ),
    "pairs": (
        ["base_pairs"],
        """SELECT seed_id, citer_id FROM base_pairs
WHERE coalesce(isinfluential, FALSE) AND NOT (flat = ['background']) AND coalesce(banded, FALSE)""",
    ),
    "en_pairs": (
        ["pairs", "citers"],
        """SELECT seed_id, citer_id FROM pairs WHERE citer_id NOT IN (
  SELECT corpusid FROM citers WHERE coalesce(lang, '') <> 'en' AND corpusid IN (
    SELECT citer_id FROM pairs WHERE seed_id IN (SELECT seed_id FROM pairs GROUP BY 1 HAVING count(*) >= 5)))""",
    ),
    "eligible": (
        ["en_pairs"],
        """SELECT seed_id, count(*) AS n_citers FROM en_pairs GROUP BY 1 HAVING count(*) >= 5""",
    ),
    "cut": (
        ["en_pairs", "eligible"],
        """SELECT p.seed_id, p.citer_id, n_citers, sha256('citer' || chr(9) || p.seed_id || chr(9) || p.citer_id) AS h
FROM en_pairs p JOIN eligible USING (seed_id)""",
    ),
    "bench": (
        ["cut", "labelled", "seeds", "citers"],
        """SELECT k.seed_id, k.citer_id, k.n_citers, k.h, s.year AS seed_year, s.citationcount AS seed_citationcount,
  s.s2fieldsofstudy AS seed_fields, length(s.abstract) AS seed_len, c.acl_id IS NOT NULL AS citer_acl, c.year AS citer_year,
  c.s2fieldsofstudy AS fields, c.citationcount AS citer_citations, length(c.abstract) AS citer_len, c.publicationdate,
  e.isinfluential, e.flat AS intents, coalesce(len(e.contexts), 0) AS n_contexts
FROM cut k JOIN labelled e ON e.citedcorpusid = k.seed_id AND e.citingcorpusid = k.citer_id
JOIN seeds s ON s.corpusid = k.seed_id JOIN citers c ON c.corpusid = k.citer_id""",
    ),
}


def _needed(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        for other in VIEWS[name][0]:
            visit(other)
        if name not in seen:
            seen.append(name)

    for name in names:
        visit(name)
    return seen


def with_views(names: list[str], query: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``query`` with the shared views it uses (and its own extra ones)."""
    parts = [f"{name} AS MATERIALIZED ({VIEWS[name][1]})" for name in _needed(names)]
    parts += [f"{name} AS MATERIALIZED ({text})" for name, text in (extra or {}).items()]
    # A view that reads itself is computed step by step.
    parts = [p.replace(" AS MATERIALIZED (", " AS (", 1) if f"FROM {p.split(' ')[0]} " in p else p for p in parts]
    return f"WITH RECURSIVE {', '.join(parts)} {query}" if parts else query


ORACLES: dict[str, str] = {}


def oracle(name: str, views: list[str], query: str, extra: dict[str, str] | None = None) -> None:
    ORACLES[name] = with_views(views, query, extra)


def build() -> dict[str, str]:
    return dict(ORACLES)


def r(expression: str) -> str:
    """Six decimals, without a negative zero."""
    return f"round({expression}, 6) + 0.0"


# ---- corpus and cut

oracle("edge_dedup", ["edges"],
       "SELECT citedcorpusid, citingcorpusid, isinfluential, array_to_string(contexts, '|') AS contexts, "
       "CAST(to_json(intents) AS VARCHAR) AS intents FROM edges")
oracle("seed_corpus", ["seeds"],
       "SELECT corpusid, acl_id, length(abstract) AS n_chars, title, year, venue, citationcount, influentialcitationcount FROM seeds")
oracle("citer_corpus", ["citers"],
       "SELECT corpusid, acl_id, length(abstract) AS n_chars, title, year, publicationdate, venue, citationcount FROM citers")
oracle("influence_thresholds", ["thresholds"], "SELECT year, floor, cap FROM thresholds")
oracle("qualifying_pairs", ["pairs"], "SELECT seed_id, citer_id FROM pairs")
oracle("pairs_with_background", ["base_pairs"],
       "SELECT seed_id, citer_id FROM base_pairs WHERE coalesce(isinfluential, FALSE) AND coalesce(banded, FALSE)")
oracle("pairs_any_influence", ["base_pairs"],
       "SELECT seed_id, citer_id FROM base_pairs WHERE NOT (flat = ['background']) AND coalesce(banded, FALSE)")
oracle("pairs_without_band", ["base_pairs"],
       "SELECT seed_id, citer_id FROM base_pairs WHERE coalesce(isinfluential, FALSE) AND NOT (flat = ['background'])")
LEARNED = {
    "letters": r"""SELECT doc_id, lang, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') AS held_out,
  string_split(' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ', '') AS c FROM documents""",
    "grams": """SELECT doc_id, lang, held_out, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM letters""",
    "counted": "SELECT lang, gram, count(*) AS n FROM grams WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1, 2",
    "vocabulary": f"""SELECT DISTINCT gram FROM (SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place FROM counted)
WHERE place <= {TOP}""",
    "profiles": """SELECT gram, lang, coalesce(n, 0) AS n, ln((coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER w + count(*) OVER w)) AS logp
FROM (SELECT DISTINCT lang FROM counted) CROSS JOIN vocabulary LEFT JOIN counted USING (lang, gram) WINDOW w AS (PARTITION BY lang)""",
    "votes": "SELECT g.doc_id, p.lang, sum(logp) AS score FROM grams g JOIN profiles p USING (gram) GROUP BY 1, 2",
    "verdicts": "SELECT doc_id, arg_min(lang, {'cost': -score, 'lang': lang}) AS detected FROM votes GROUP BY 1",
}
oracle("language_profiles", [], f"SELECT gram, lang, n, {r('logp')} AS logp FROM profiles", LEARNED)
oracle("language_verdicts", [], "SELECT l.doc_id, l.lang, l.held_out, detected FROM letters l LEFT JOIN verdicts USING (doc_id)", LEARNED)
oracle("english_pairs", ["pairs", "citers"],
       """SELECT seed_id, citer_id FROM pairs WHERE citer_id NOT IN (
  SELECT corpusid FROM citers LEFT JOIN verdicts ON doc_id = corpusid WHERE coalesce(detected, '') <> 'en' AND corpusid IN (
    SELECT citer_id FROM pairs WHERE seed_id IN (SELECT seed_id FROM pairs GROUP BY 1 HAVING count(*) >= 5)))""", LEARNED)
oracle("eligible_seeds", ["eligible"], "SELECT seed_id, n_citers FROM eligible")
oracle("capped_cut", ["en_pairs", "eligible"],
       "SELECT seed_id, citer_id, n_citers FROM ranked WHERE rn <= 6",
       {"kept": "SELECT seed_id, n_citers FROM eligible ORDER BY sha256('seed' || chr(9) || seed_id), seed_id LIMIT 50",
        "ranked": "SELECT seed_id, citer_id, n_citers, row_number() OVER (PARTITION BY seed_id ORDER BY "
                  "sha256('citer' || chr(9) || seed_id || chr(9) || citer_id), citer_id) AS rn "
                  "FROM en_pairs JOIN kept USING (seed_id)"})
oracle("benchmark_records", ["bench", "seeds"],
       """SELECT CAST(b.seed_id AS VARCHAR) AS seed_id, any_value(s.acl_id) AS acl_id, any_value(s.title) AS seed_title,
  any_value(n_citers) AS n_citers_qualifying, string_agg(CAST(citer_id AS VARCHAR), ',' ORDER BY h) AS citer_ids,
  sum(n_contexts) AS n_contexts, sum(len(intents)) AS n_intents, sum(citer_len) AS citer_chars
FROM bench b JOIN seeds s ON s.corpusid = b.seed_id GROUP BY b.seed_id""")


def quants(value: str, names: dict[str, float], kind: str = "quantile_cont") -> str:
    return ", ".join(f"{r(f'{kind}({value}, {p})')} AS {n}" for n, p in names.items())


SUMMARY = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}

# ---- corpus statistics

LINKS = {"links": """SELECT s.corpusid AS seed_id, s.s2fieldsofstudy AS seed_fields, c.corpusid AS citer_id,
  c.abstract IS NOT NULL AS has_abstract, c.acl_id IS NOT NULL AS is_acl, c.venue, c.s2fieldsofstudy AS fields
FROM edges e JOIN seeds s ON s.corpusid = e.citedcorpusid JOIN citers c ON c.corpusid = e.citingcorpusid
WHERE s.year BETWEEN 1985 AND 1997"""}
PER_SEED = {**LINKS, "per_seed": """SELECT s.corpusid, coalesce(n, 0) AS n FROM seeds s
LEFT JOIN (SELECT seed_id, CAST(sum(has_abstract::INT) AS BIGINT) AS n FROM links GROUP BY 1) ON seed_id = s.corpusid
WHERE s.year BETWEEN 1985 AND 1997"""}

oracle("edge_counts", ["edges", "seeds", "citers"],
       f"""SELECT count(*) AS n_edges, CAST(sum(has_abstract::INT) AS BIGINT) AS n_edges_with_abstract,
  {r("avg(CASE WHEN has_abstract THEN is_acl::INT END)")} AS citer_is_acl_frac,
  {r("avg(CASE WHEN has_abstract THEN coalesce(list_has_any(fields, seed_fields), FALSE)::INT END)")} AS citer_same_field_frac
FROM links""", LINKS)
oracle("citers_per_seed_bins", ["edges", "seeds", "citers"],
       """SELECT bin, (SELECT count(*) FROM per_seed WHERE n BETWEEN lo AND hi) AS n_seeds
FROM (VALUES ('0-0', 0, 0), ('1-4', 1, 4), ('5-9', 5, 9), ('10-19', 10, 19), ('20-49', 20, 49), ('50-99', 50, 99),
             ('100-499', 100, 499), ('500-inf', 500, 1000000000)) b(bin, lo, hi)""", PER_SEED)
oracle("citers_per_seed_quantiles", ["edges", "seeds", "citers"],
       f"SELECT count(*) AS n, {r('avg(n)')} AS mean, {quants('n', SUMMARY)} FROM per_seed", PER_SEED)
oracle("top_fields", ["edges", "seeds", "citers"],
       """SELECT field, count(*) AS n FROM (SELECT unnest(fields) AS field FROM links WHERE has_abstract)
GROUP BY 1 ORDER BY n DESC, field LIMIT 15""", LINKS)
oracle("top_venues", ["edges", "seeds", "citers"],
       """SELECT venue, count(*) AS n FROM links WHERE has_abstract AND NOT is_acl AND venue IS NOT NULL
GROUP BY 1 ORDER BY n DESC, venue LIMIT 20""", LINKS)
oracle("duplicate_copies", ["raw_edges"],
       "SELECT copies, count(*) AS n_pairs FROM (SELECT count(*) AS copies FROM raw_edges GROUP BY citedcorpusid, citingcorpusid) GROUP BY 1")
oracle("edge_overview", ["raw_edges"],
       """SELECT count(*) AS n_rows, CAST(sum((citedcorpusid = citingcorpusid)::INT) AS BIGINT) AS self_rows,
  CAST(sum(isinfluential::INT) AS BIGINT) AS influential_rows, count(contexts) AS with_contexts, count(intents) AS with_intents,
  (SELECT count(*) FROM (SELECT DISTINCT citedcorpusid, citingcorpusid FROM raw_edges)) AS distinct_pairs,
  count(DISTINCT citedcorpusid) AS distinct_cited, count(DISTINCT citingcorpusid) AS distinct_citing FROM raw_edges""")
oracle("in_degree_quantiles", ["raw_edges"],
       "SELECT count(*) AS n, " + quants("d", {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99, "p999": 0.999, "max": 1.0})
       + " FROM (SELECT count(DISTINCT citingcorpusid) AS d FROM raw_edges GROUP BY citedcorpusid)")
oracle("context_sizes", ["raw_edges"],
       "SELECT CAST(coalesce(len(contexts), 0) AS INTEGER) AS n_contexts, count(*) AS n_rows FROM raw_edges GROUP BY 1")
oracle("intent_label_rows", ["raw_edges"],
       """SELECT intent, count(*) AS n_rows FROM (SELECT unnest(list_distinct(list_filter(
  flatten(list_filter(intents, lambda l: l IS NOT NULL)), lambda x: x IS NOT NULL AND x <> ''))) AS intent FROM raw_edges) GROUP BY 1""")
oracle("abstracts_by_year", ["cited_papers"],
       """SELECT year, count(*) AS n_papers, count(text) AS with_abstract FROM cited_papers LEFT JOIN documents ON doc_id = corpusid
WHERE acl_id IS NOT NULL GROUP BY 1""")

# ---- benchmark pairs and plot tables

COVARIATES = {"cov": """SELECT seed_id, CAST(citer_id AS VARCHAR) AS citer_id, citer_id AS citer_key,
  coalesce(list_has_any(fields, seed_fields), FALSE) AS same_field, citer_acl,
  CAST(coalesce(nullif(citer_year, 0), seed_year) - seed_year AS INTEGER) AS horizon,
  CASE WHEN coalesce(nullif(citer_year, 0), seed_year) < seed_year THEN 'neg'
       WHEN coalesce(nullif(citer_year, 0), seed_year) - seed_year <= 1 THEN '0-1y'
       WHEN coalesce(nullif(citer_year, 0), seed_year) - seed_year <= 3 THEN '2-3y'
       WHEN coalesce(nullif(citer_year, 0), seed_year) - seed_year <= 6 THEN '4-6y' ELSE '7y+' END AS horizon_bucket,
  coalesce(isinfluential, FALSE) AS influential, coalesce(nullif(array_to_string(intents, '/'), ''), 'unknown') AS intent,
  CAST(coalesce(citer_citations, 0) AS INTEGER) AS citer_citations FROM bench"""}


def year_bars(source: str) -> str:
    return f"""SELECT CASE WHEN y < 1990 THEN '<1990' ELSE CAST(y AS VARCHAR) END AS label, count(x.year) AS n
FROM (SELECT unnest(range(1989, (SELECT greatest(max(year), 1990) FROM {source}) + 1)) AS y) a
LEFT JOIN {source} x ON greatest(x.year, 1989) = y GROUP BY y"""


LOG_BINS = """(VALUES (0, '1', 1, 2), (1, '2', 2, 3), (2, '3-4', 3, 5), (3, '5-9', 5, 10), (4, '10-19', 10, 20), (5, '20-29', 20, 30),
  (6, '30-49', 30, 50), (7, '50-99', 50, 100), (8, '100-199', 100, 200), (9, '200-299', 200, 300), (10, '300-499', 300, 500),
  (11, '500-999', 500, 1000), (12, '1,000-1,999', 1000, 2000), (13, '2,000-4,999', 2000, 5000), (14, '5,000-9,999', 5000, 10000),
  (15, '10,000+', 10000, 1000000001)) b(bin, label, lo, hi)"""
HISTOGRAM = {"h": f"""SELECT bin, label, (SELECT count(*) FROM seeds WHERE citationcount >= lo AND citationcount < hi) AS n FROM {LOG_BINS}"""}
CURVE = {"sizes": "SELECT n_citers, count(*) AS n_seeds FROM eligible GROUP BY 1",
         "curve": """SELECT n_citers, n_seeds, sum(n_seeds) OVER w AS cum_seeds, sum(n_seeds * n_citers) OVER w AS cum_pairs,
  sum(n_seeds) OVER () AS all_seeds, sum(n_seeds * n_citers) OVER () AS all_pairs
FROM sizes WINDOW w AS (ORDER BY n_citers DESC)"""}

oracle("pair_covariates", ["bench"], "SELECT * EXCLUDE (citer_key) FROM cov", COVARIATES)
oracle("covariate_shares", ["bench"],
       f"""SELECT {r('avg(same_field::INT)')} AS same_field_frac, {r('avg(citer_acl::INT)')} AS citer_acl_frac,
  {r('avg(influential::INT)')} AS influential_frac FROM cov""", COVARIATES)
oracle("horizon_buckets", ["bench"], "SELECT horizon_bucket, count(*) AS n FROM cov GROUP BY 1", COVARIATES)
oracle("top_intents", ["bench"], "SELECT intent, count(*) AS n FROM cov GROUP BY 1 ORDER BY n DESC, intent LIMIT 12", COVARIATES)
oracle("seeds_per_year", ["eligible", "seeds"], year_bars("chosen"),
       {"chosen": "SELECT year FROM seeds WHERE corpusid IN (SELECT seed_id FROM eligible)"})
oracle("citers_per_year", ["bench"], year_bars("cy"), {"cy": "SELECT citer_year AS year FROM bench"})
oracle("seed_citation_bins", ["seeds"],
       """SELECT bin, label, n FROM h WHERE bin BETWEEN (SELECT min(bin) FROM h WHERE n > 0) AND (SELECT max(bin) FROM h WHERE n > 0)""",
       HISTOGRAM)
oracle("seed_citation_note", ["seeds"],
       f"""SELECT count(citationcount) AS n, {r('quantile_cont(citationcount, 0.5)')} AS median,
  (SELECT label FROM h ORDER BY n DESC, bin LIMIT 1) AS fullest_bin FROM seeds""", HISTOGRAM)
oracle("concentration_curve", ["eligible"],
       f"""SELECT n_citers, n_seeds, CAST(cum_seeds AS BIGINT) AS cum_seeds, CAST(cum_pairs AS BIGINT) AS cum_pairs,
  {r('100.0 * cum_seeds / all_seeds')} AS seed_share, {r('100.0 * cum_pairs / all_pairs')} AS pair_share FROM curve""", CURVE)
oracle("top_seed_shares", ["eligible"],
       f"""SELECT pct, CAST(k AS BIGINT) AS top_seeds, {r('100.0 * sum(n_citers) FILTER (WHERE rn <= k) / sum(n_citers)')} AS pair_share
FROM (SELECT n_citers, row_number() OVER (ORDER BY n_citers DESC) AS rn FROM eligible),
     (SELECT pct, greatest(1, round_even((SELECT count(*) FROM eligible) * pct / 100.0, 0)) AS k FROM (VALUES (1), (10)) v(pct))
GROUP BY pct, k""")
oracle("nearest_rank_quantiles", ["eligible"],
       "SELECT " + ", ".join(f"v[CAST(round_even({p} * (len(v) - 1), 0) AS INTEGER) + 1] AS {n}" for n, p in {**SUMMARY, "max": 1.0}.items())
       + f", {r('round_even(list_sum(v) / len(v), 2)')} AS mean FROM (SELECT list_sort(list(n_citers)) AS v FROM eligible)")
oracle("horizon_bars", ["bench"],
       """SELECT CAST(b AS INTEGER) AS bin, CASE WHEN b = 16 THEN '16+' ELSE CAST(b AS VARCHAR) END AS label, count(horizon) AS n
FROM (SELECT unnest(range(0, 17)) AS b) LEFT JOIN (SELECT horizon FROM cov WHERE horizon >= 0) ON least(horizon, 16) = b GROUP BY b""",
       COVARIATES)
oracle("horizon_note", ["bench"], f"SELECT count(*) AS n, {quants('horizon', {'median': 0.5, 'p90': 0.9})} FROM cov", COVARIATES)
oracle("length_histogram", [],
       """SELECT CAST(b AS INTEGER) AS bin_start, count(n) AS n FROM (SELECT unnest(range(200, 5000, 100)) AS b)
LEFT JOIN (SELECT length(text) AS n FROM documents) ON n >= b AND (n < b + 100 OR (b = 4900 AND n = 5000)) GROUP BY b""")
oracle("field_shares", ["bench"],
       f"""SELECT field, count(*) AS n, {r('100.0 * count(*) / (SELECT count(*) FROM bench)')} AS share
FROM (SELECT unnest(list_distinct(fields)) AS field FROM bench) GROUP BY 1 ORDER BY n DESC, field LIMIT 10""")

# ---- similarity

SIMS = {
    "known": """SELECT b.*, sv.embedding::DOUBLE[] AS seed_vec, cv.embedding::DOUBLE[] AS vec FROM bench b
JOIN embeddings sv ON sv.vec_id = b.seed_id JOIN embeddings cv ON cv.vec_id = b.citer_id""",
    "placed": """SELECT seed_id, any_value(seed_vec) AS seed_vec, row_number() OVER (ORDER BY seed_id) - 1 AS ix,
  count(*) OVER () AS n FROM known GROUP BY seed_id""",
    "sims": """SELECT k.seed_id, k.citer_id, k.intents, list_dot_product(k.vec, k.seed_vec) AS sim, list_dot_product(k.vec, o.seed_vec) AS null_sim
FROM known k JOIN placed p ON p.seed_id = k.seed_id JOIN placed o ON o.ix = (p.ix +
  CAST('0x' || substr(sha256('0' || chr(9) || k.seed_id || chr(9) || k.citer_id), 1, 8) AS BIGINT) % (p.n - 1) + 1) % p.n""",
}
oracle("pair_similarities", ["bench"], f"SELECT seed_id, citer_id, {r('sim')} AS sim, {r('null_sim')} AS null_sim FROM sims", SIMS)
oracle("similarity_by_stratum", ["bench"],
       f"SELECT stratum, count(*) AS n, {r('avg(sim)')} AS mean, {quants('sim', SUMMARY)} FROM strata GROUP BY 1",
       {**SIMS, **COVARIATES,
        "joined": "SELECT cov.*, sims.sim FROM cov JOIN sims ON sims.seed_id = cov.seed_id AND sims.citer_id = cov.citer_key",
        "common": "SELECT intent FROM joined GROUP BY 1 ORDER BY count(*) DESC, intent LIMIT 6",
        "strata": """SELECT 'all' AS stratum, sim FROM joined UNION ALL SELECT 'same_field=' || CAST(same_field AS VARCHAR), sim FROM joined
UNION ALL SELECT 'citer_acl=' || CAST(citer_acl AS VARCHAR), sim FROM joined
UNION ALL SELECT 'influential=' || CAST(influential AS VARCHAR), sim FROM joined
UNION ALL SELECT 'horizon=' || horizon_bucket, sim FROM joined WHERE horizon_bucket <> 'neg'
UNION ALL SELECT 'intent=' || intent, sim FROM joined WHERE intent IN (SELECT intent FROM common)"""})
oracle("intent_similarity", ["bench"],
       f"""SELECT code, name, n, p10, p25, p50, p75, p90, above FROM (
SELECT code, CASE code WHEN 0 THEN 'no label' WHEN 1 THEN 'background' WHEN 2 THEN 'methodology' WHEN 3 THEN 'background + methodology'
  WHEN 4 THEN 'result' WHEN 5 THEN 'background + result' WHEN 6 THEN 'methodology + result' ELSE 'background + methodology + result' END AS name,
  count(*) AS n, {quants('sim', SUMMARY)},
  {r('100.0 * avg((sim > (SELECT quantile_cont(null_sim, 0.95) FROM sims))::INT)')} AS above FROM coded GROUP BY 1
UNION ALL SELECT -1, 'random other seed', count(*), {quants('null_sim', SUMMARY)}, 5.0 FROM sims)""",
       {**SIMS, "coded": """SELECT *, CAST(list_contains(intents, 'background')::INT + 2 * list_contains(intents, 'methodology')::INT
  + 4 * list_contains(intents, 'result')::INT AS INTEGER) AS code FROM sims"""})

VEC = {"vec": """SELECT label AS seed_id, vec_id AS item_id, embedding::DOUBLE[] AS vec, coalesce(lang, '') = 'en' AS is_target, lang
FROM embeddings LEFT JOIN documents ON doc_id = vec_id"""}
BEST = {**VEC, "best": """SELECT t.seed_id, t.item_id, max(list_dot_product(t.vec, g.vec)) AS best_cos
FROM vec t LEFT JOIN (SELECT * FROM vec WHERE NOT is_target) g ON g.seed_id = t.seed_id WHERE t.is_target GROUP BY 1, 2"""}
SEED_SIMS = {**VEC, "s": """SELECT v.seed_id, v.item_id, list_dot_product(v.vec, f.vec) AS sim FROM vec v
JOIN (SELECT seed_id, arg_min(vec, item_id) AS vec FROM vec GROUP BY 1) f USING (seed_id)"""}

oracle("best_similarity", [], f"SELECT seed_id, item_id, {r('best_cos')} AS best_cos FROM best", BEST)
oracle("cosine_coverage", [],
       f"SELECT seed_id, {r('avg(best_cos)')} AS coverage, count(best_cos) AS n_targets FROM best GROUP BY 1", BEST)
oracle("coverage_at_tau", [], f"SELECT seed_id, {r('avg(coalesce(best_cos >= 0.25, FALSE)::INT)')} AS coverage_at_tau FROM best GROUP BY 1", BEST)
oracle("null_tau", [], f"SELECT {r('quantile_cont(best_cos, 0.95)')} AS tau FROM best", BEST)
oracle("mean_pairwise_similarity", [],
       f"""SELECT a.seed_id, count(DISTINCT a.item_id) AS n, {r("coalesce(avg(list_dot_product(a.vec, b.vec)) FILTER (WHERE a.item_id <> b.item_id), 'nan'::DOUBLE)")} AS mps
FROM vec a JOIN vec b USING (seed_id) GROUP BY 1""", VEC)
oracle("centroid_dispersion", [],
       f"""SELECT seed_id, n, CASE WHEN n < 2 THEN 'nan'::DOUBLE ELSE {r('1.0 - (len * len) / (len + 1e-12)')} END AS disp
FROM (SELECT seed_id, max(n) AS n, sqrt(sum(s * s)) / max(n) AS len FROM
  (SELECT seed_id, i, sum(x) AS s, count(*) AS n FROM
    (SELECT seed_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vec) GROUP BY 1, 2) GROUP BY 1)""", VEC)
# Two-sided Jacobi rotations on the second-moment matrix, 64 x 64 as a list. In a step every index has one partner (a round of a
# tournament), so 32 rotations that do not touch each other are one rewriting of the list; 63 steps meet all pairs.
SIDE, SWEEPS = 64, 8
PLACES, CELLS = f"range({SIDE})", f"range({SIDE * SIDE})"
cell = lambda i, j: f"a[({i}) * {SIDE} + ({j}) + 1]"
of = lambda name, i: f"{name}[({i}) + 1]"
ROW, COLUMN = f"k // {SIDE}", f"k % {SIDE}"
TURNED = " + ".join(
    f"{of(x, ROW)} * {of(y, COLUMN)} * {cell(i, j)}"
    for x, i in (("c", ROW), ("g", of("p", ROW))) for y, j in (("c", COLUMN), ("g", of("p", COLUMN))))
JACOBI = {
    **VEC,
    "moments": f"""SELECT seed_id, any_value(n) AS n, list(v ORDER BY i, j) AS a FROM (
  SELECT seed_id, count(*) AS n, i, j, sum(vec[i] * vec[j]) / count(*) AS v
  FROM vec, (SELECT unnest(range(1, {SIDE + 1})) AS i), (SELECT unnest(range(1, {SIDE + 1})) AS j) GROUP BY seed_id, i, j) GROUP BY seed_id""",
    "turned": f"""SELECT seed_id, n, 0 AS step, a FROM moments UNION ALL
SELECT seed_id, n, step + 1, list_transform({CELLS}, lambda k: {TURNED}) FROM (
  SELECT *, list_transform({PLACES}, lambda i: 1 / sqrt(1 + {of('t', 'i')} ** 2)) AS c,
    list_transform({PLACES}, lambda i: CASE WHEN i < {of('p', 'i')} THEN -1 ELSE 1 END * {of('t', 'i')} / sqrt(1 + {of('t', 'i')} ** 2)) AS g
  FROM (SELECT *, list_transform({PLACES}, lambda i: CASE WHEN {of('o', 'i')} = 0 THEN 0.0 ELSE CASE WHEN {of('d', 'i')} < 0 THEN -1 ELSE 1 END
      * 2 * {of('o', 'i')} / (abs({of('d', 'i')}) + sqrt({of('d', 'i')} ** 2 + 4 * {of('o', 'i')} ** 2)) END) AS t
    FROM (SELECT *, list_transform({PLACES}, lambda i: {cell('i', of('p', 'i'))}) AS o,
        list_transform({PLACES}, lambda i: a[greatest(i, {of('p', 'i')}) * {SIDE + 1} + 1] - a[least(i, {of('p', 'i')}) * {SIDE + 1} + 1]) AS d
      FROM (SELECT *, list_transform({PLACES}, lambda i: CASE WHEN i = {SIDE - 1} THEN step % {SIDE - 1} WHEN i = step % {SIDE - 1} THEN {SIDE - 1}
          ELSE (2 * (step % {SIDE - 1}) - i + {2 * SIDE - 2}) % {SIDE - 1} END) AS p FROM turned WHERE step < {SWEEPS * (SIDE - 1)}))))""",
}
oracle("vendi", [], f"""SELECT seed_id, n, {r('exp(-list_sum(list_transform(list_filter(spectrum, lambda x: x > 1e-12), lambda x: x * ln(x))))')} AS vendi
FROM (SELECT seed_id, n, list_transform({PLACES}, lambda i: {cell('i', 'i')}) AS spectrum FROM turned WHERE step = {SWEEPS * (SIDE - 1)})""", JACOBI)
oracle("seed_similarity", [], f"SELECT seed_id, item_id, {r('sim')} AS sim FROM s", SEED_SIMS)
oracle("similarity_density", [],
       f"""SELECT CAST(b AS INTEGER) AS bin, count(x.sim) AS n, {r('count(x.sim) / ((SELECT count(*) FROM inside) * (any_value(hi) - any_value(lo)) / 60)')} AS density
FROM (SELECT unnest(range(0, 60)) AS b) CROSS JOIN bounds LEFT JOIN (SELECT sim, least(floor((sim - lo) / (hi - lo) * 60), 59) AS k FROM inside) x ON x.k = b
GROUP BY b""",
       {**SEED_SIMS, "bounds": "SELECT quantile_cont(sim, 0.005) AS lo, max(sim) AS hi FROM s",
        "inside": "SELECT sim, lo, hi FROM s, bounds WHERE sim BETWEEN lo AND hi"})

# ---- recall

MATCHES = {"em": """SELECT event_type AS condition, user_id AS seed_id, CAST(count(*) AS INTEGER) AS n_gen,
  CAST(sum((value > 50)::INT) AS INTEGER) AS m FROM events GROUP BY 1, 2"""}


def recall(k: str) -> str:
    return (f"1.0 - list_aggregate(list_transform(range(0, least({k}, n_gen)), "
            f"lambda i: greatest(n_gen - m - i, 0)::DOUBLE / (n_gen - i)), 'product')")


oracle("recall_at_k", [],
       f"SELECT condition, seed_id, n_gen, m, {r(recall('10'))} AS recall_10, {r(recall('51'))} AS recall_51 FROM em", MATCHES)
oracle("recall_curve", [],
       f"""SELECT condition, CAST(k AS INTEGER) AS k, {r('avg(' + recall('k') + ')')} AS recall
FROM em, (SELECT unnest([1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 51]) AS k) GROUP BY 1, 2""", MATCHES)
oracle("recall_gain", [],
       f"SELECT condition, k, {r('recall')} AS recall, {r('recall - first_value(recall) OVER (PARTITION BY condition ORDER BY k)')} AS gain FROM cu",
       {**MATCHES, "cu": f"""SELECT condition, CAST(k AS INTEGER) AS k, avg({recall('k')}) AS recall
FROM em, (SELECT unnest(range(1, 52)) AS k) GROUP BY 1, 2"""})

# ---- targets and shards

oracle("shuffled_targets", ["en_pairs"],
       """SELECT d.seed_id, p.citer_id FROM donor d JOIN en_pairs p ON p.seed_id = d.donor_id
WHERE NOT EXISTS (SELECT 1 FROM en_pairs o WHERE o.seed_id = d.seed_id AND o.citer_id = p.citer_id)""",
       {"donor": """SELECT seed_id, coalesce(lead(seed_id) OVER (ORDER BY h), first_value(seed_id) OVER (ORDER BY h)) AS donor_id
FROM (SELECT DISTINCT seed_id, sha256('shuffle' || chr(9) || seed_id) AS h FROM en_pairs)"""})
oracle("common_seeds", [],
       """SELECT user_id AS seed_id FROM events GROUP BY 1
HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)""")
oracle("shard_assignment", [],
       """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index,
  CAST((row_number() OVER (ORDER BY doc_id) - 1) % 8 AS INTEGER) AS shard FROM documents""")
oracle("pilot_subset", [],
       """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
WHERE n <= 50 OR (i % (n // 50) = 0 AND i // (n // 50) < 50)""")

# ---- contrast

SYSTEMS = {"per_seed": """SELECT o_orderpriority || '/' || o_orderstatus AS system, o_custkey AS seed_id, avg(o_totalprice) AS coverage,
  count(*)::DOUBLE AS vendi, min(o_totalprice) AS mps, max(o_totalprice) - min(o_totalprice) AS disp,
  avg(dayofyear(o_orderdate)) AS mean_len FROM orders GROUP BY 1, 2"""}
ONE_SYSTEM_TABLE = {**SYSTEMS, "tab": """SELECT system, avg(coverage) AS coverage, avg(vendi) AS vendi, avg(mps) AS mps, avg(disp) AS disp,
  avg(mean_len) AS mean_len FROM per_seed GROUP BY 1"""}
RANKED = {**SYSTEMS, "long": """SELECT system, coverage, metric, value FROM (SELECT system, coverage, unnest(['vendi', 'mps', 'disp', 'mean_len']) AS metric,
  unnest([vendi, mps, disp, mean_len]) AS value FROM per_seed)""",
        "kept": "SELECT * FROM long WHERE (system, metric) IN (SELECT (system, metric) FROM long GROUP BY system, metric HAVING count(*) >= 10)",
        "pooled": "SELECT * FROM kept UNION ALL SELECT 'pooled', coverage, metric, value FROM kept",
        "ranked": """SELECT system, metric,
  rank() OVER (PARTITION BY system, metric ORDER BY coverage) + (count(*) OVER (PARTITION BY system, metric, coverage) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY system, metric ORDER BY value) + (count(*) OVER (PARTITION BY system, metric, value) - 1) / 2.0 AS ry FROM pooled"""}
oracle("spearman", [], f"""SELECT system, metric, {r('corr(ry, rx)')} AS rho, count(*) AS n FROM ranked GROUP BY 1, 2 HAVING count(*) >= 10""", RANKED)
# Without correlation rho = sin(angle) has a density like cos(angle) to the power n - 3; both integrals by Simpson's rule.
SIMPSON = "list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 ELSE 2 + 2 * (i % 2) END) * cos({low} + i * ({high} - {low}) / 4000) ** (n - 3))) * ({high} - {low})"
oracle("spearman_significance", [], f"""SELECT system, metric, {r(f"({SIMPSON.format(low='asin(least(abs(rho), 1))', high='pi() / 2')}) / ({SIMPSON.format(low='0', high='pi() / 2')})")} AS p
FROM (SELECT system, metric, corr(ry, rx) AS rho, count(*) AS n FROM ranked GROUP BY 1, 2 HAVING count(*) >= 10)""", RANKED)
oracle("system_table", [],
       "SELECT system, " + ", ".join(f"{r(m)} AS {m}" for m in ("coverage", "vendi", "mps", "disp", "mean_len")) + " FROM tab", ONE_SYSTEM_TABLE)
oracle("system_rankings", [],
       """SELECT model, metric, system, CAST(row_number() OVER (PARTITION BY model, metric ORDER BY key, system) AS INTEGER) AS place FROM (
SELECT system, split_part(system, '/', 1) AS model, unnest(['coverage', 'vendi', 'mps', 'disp', 'mean_len']) AS metric,
  unnest([-coverage, -vendi, mps, -disp, -mean_len]) AS key FROM tab)""", ONE_SYSTEM_TABLE)
oracle("decile_coverage", [],
       f"""SELECT system, CAST(least(greatest(len(list_filter(edges, lambda e: e <= l_extendedprice)) - 1, 0), 9) AS INTEGER) AS decile,
  {r('avg((l_tax > 0 AND l_discount >= 0.05)::INT)')} AS coverage, count(*) AS n_pairs
FROM (SELECT 'all' AS system, * FROM lineitem UNION ALL SELECT l_returnflag, * FROM lineitem WHERE l_returnflag <> 'R'), (SELECT quantile_cont(l_extendedprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS edges
  FROM (SELECT max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_orderkey, l_linenumber)) GROUP BY 1, 2""")
oracle("agreement_kappa", [],
       f"""SELECT n, {r('(same / n - chance) / (1 - chance)')} AS kappa, {r('tp / greatest(n_pred, 1)')} AS precision, {r('tp / greatest(n_ref, 1)')} AS recall
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS same, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp,
  count(*) FILTER (WHERE toxic = 1) AS n_pred, count(*) FILTER (WHERE quality = 1) AS n_ref FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
 (SELECT sum(a.c * b.c) / (SELECT count(*) FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) ** 2 AS chance
  FROM (SELECT quality AS v, count(*) AS c FROM labels WHERE toxic IS NOT NULL GROUP BY 1) a JOIN (SELECT toxic AS v, count(*) AS c FROM labels WHERE quality IS NOT NULL GROUP BY 1) b USING (v))""")

# ---- resampling and lexical

BOUNDS = "[" + ", ".join(str(b) for b in POISSON_BOUNDS) + "]"


def boot(cells: str, key: str) -> dict[str, str]:
    return {
        "cells": cells,
        "draws": """SELECT *, sha256(concat_ws('|', CAST(u AS VARCHAR), CAST(block AS VARCHAR), '0')) AS h FROM cells, (SELECT unnest(range(0, 125)) AS block)""",
        "weights": f"""SELECT {key}, total, cnt, block * 8 + k AS b, len(list_filter({BOUNDS}::BIGINT[],
  lambda t: CAST('0x' || substr(h, CAST(k * 8 + 1 AS BIGINT), 8) AS BIGINT) >= t)) AS w FROM draws, (SELECT unnest(range(0, 8)) AS k)""",
        "replicates": f"SELECT {key}, b, sum(w * total) / greatest(sum(w * cnt), 1) AS ratio FROM weights GROUP BY 1, 2",
        "means": f"SELECT {key}, sum(total) AS t, sum(cnt) AS c FROM cells GROUP BY 1",
    }


def boot_sql(key: str) -> str:
    pick = lambda e: f"CASE WHEN any_value(c) > 0 THEN {r(e)} ELSE 'nan'::DOUBLE END"
    return f"""SELECT {key}, {pick('any_value(t) / any_value(c)')} AS mean, {pick('quantile_cont(ratio, 0.025)')} AS ci_low,
  {pick('quantile_cont(ratio, 0.975)')} AS ci_high FROM replicates JOIN means USING ({key}) GROUP BY 1"""


oracle("bootstrap_mean", [], boot_sql("c_mktsegment"), boot("SELECT c_mktsegment, c_custkey AS u, c_acctbal::DOUBLE AS total, 1.0 AS cnt FROM customer", "c_mktsegment"))
oracle("bootstrap_pooled", [], boot_sql("event_type"),
       boot("SELECT event_type, user_id AS u, coalesce(sum(value), 0)::DOUBLE AS total, count(value)::DOUBLE AS cnt FROM events GROUP BY 1, 2", "event_type"))
oracle("self_bleu", [],
       f"""SELECT role, conv_id, CASE WHEN count(*) < 2 THEN 'nan'::DOUBLE ELSE {r('avg(bleu)')} END AS self_bleu FROM scored GROUP BY 1, 2""",
       {"toks": r"""SELECT role, conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' ||
  replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '\s+$', ''), '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ',
  '([\{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\s+'), lambda x: x <> '') AS w
  FROM conversations WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""",
        "grams": """SELECT role, conv_id, turn, n, g, count(*) AS c FROM (SELECT role, conv_id, turn, n,
  unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i:i + n - 1], chr(9)))) AS g FROM toks, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL""",
        "clipped": """SELECT a.role, a.conv_id, a.turn, a.n, a.g, least(any_value(a.c), max(b.c)) AS hit FROM grams a JOIN grams b
  ON a.role = b.role AND a.conv_id = b.conv_id AND a.n = b.n AND a.g = b.g AND a.turn <> b.turn GROUP BY 1, 2, 3, 4, 5""",
        "hits": "SELECT role, conv_id, turn, n, sum(hit) AS h FROM clipped GROUP BY ALL",
        "reflen": """SELECT a.role, a.conv_id, a.turn, arg_min(len(b.w), abs(len(b.w) - len(a.w)) * 100000 + len(b.w)) AS closest FROM toks a JOIN toks b
  ON a.role = b.role AND a.conv_id = b.conv_id AND a.turn <> b.turn GROUP BY 1, 2, 3""",
        "parts": """SELECT t.role, t.conv_id, t.turn, len(t.w) AS l, n, len(t.w) - n + 1 AS total, coalesce(h, 0) AS h, closest,
  sum(CASE WHEN coalesce(h, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY t.role, t.conv_id, t.turn ORDER BY n) AS z
  FROM toks t CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) LEFT JOIN hits USING (role, conv_id, turn, n) LEFT JOIN reflen USING (role, conv_id, turn)""",
        "scored": """SELECT role, conv_id, turn, CASE WHEN sum(h) > 0 THEN CASE WHEN any_value(l) >= any_value(closest) THEN 1.0 ELSE exp(1 - any_value(closest) / any_value(l)) END
  * exp(avg(CASE WHEN h > 0 THEN ln(100.0 * h / total) ELSE ln(100.0 / (2.0 ** z * total)) END) FILTER (WHERE total > 0)) ELSE 0.0 END AS bleu FROM parts GROUP BY 1, 2, 3"""})

oracle("distinct_2", [],
       f"""SELECT role, conv_id, CASE WHEN count(g) = 0 THEN 'nan'::DOUBLE ELSE {r('count(DISTINCT g) / count(g)')} END AS distinct2
FROM (SELECT role, conv_id, unnest(CASE WHEN len(w) < 2 THEN [NULL] ELSE list_transform(range(1, len(w)), lambda i: w[i] || chr(9) || w[i + 1]) END) AS g
  FROM (SELECT role, conv_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM conversations)) GROUP BY 1, 2""")
oracle("mean_length", [],
       f"""SELECT role, conv_id, {r('avg(n)')} AS mean_len FROM (SELECT role, conv_id,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations) GROUP BY 1, 2""")

# The recursive view goes through the answer token by token; a state holds the common length up to every token of the question.
oracle("rouge_l_unstemmed", [],
       f"""SELECT conv_id, {r('avg(best)')} AS rouge_l FROM (
  SELECT conv_id, turn, max(CASE WHEN shared = 0 THEN 0 ELSE 2 * (shared / m) * (shared / n) / (shared / m + shared / n) END) AS best FROM common GROUP BY 1, 2) GROUP BY 1""",
       {"said": """SELECT conv_id, turn, role, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations""",
        "met": """SELECT u.conv_id, u.turn, a.turn AS other, u.w AS x, a.w AS y FROM said u JOIN said a USING (conv_id)
  WHERE u.role = 'user' AND a.role = 'assistant' AND regexp_matches(a.text, '\\S')""",
        "common": """WITH RECURSIVE walk AS (SELECT conv_id, turn, other, x, y, 0 AS k, list_transform(x, lambda t: 0) AS state FROM met
  UNION ALL SELECT conv_id, turn, other, x, y, k + 1,
    list_transform(range(1, len(x) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i:
      CASE WHEN x[i] = y[k + 1] THEN 1 + CASE WHEN i = 1 THEN 0 ELSE state[i - 1] END ELSE state[i] END))) FROM walk WHERE k < len(y))
  SELECT conv_id, turn, len(x) AS m, len(y) AS n, coalesce(state[-1], 0) AS shared FROM walk WHERE k = len(y)"""})

# ---- model output and result removal

REPLIES = {"answers": """SELECT doc_id, CASE lang WHEN 'en' THEN '**Abstract:** ' || text
  WHEN 'de' THEN 'Title: ' || source || chr(10) || chr(10) || text WHEN 'fr' THEN '**Header**' || chr(10) || text ELSE '' END AS a, lang, text FROM documents"""}
TRIM = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
oracle("strip_reasoning", [], "SELECT doc_id, md5(a) AS answer FROM answers", REPLIES)
oracle("parse_list", [],
       "SELECT doc_id, CAST(CASE WHEN lang IN ('de', 'fr') THEN 1 ELSE 2 END AS INTEGER) AS n, md5(" + TRIM.format("text")
       + ") AS first, CASE WHEN lang NOT IN ('de', 'fr') THEN source END AS second FROM documents")

ROLE = ("CASE WHEN length(s) < 20 THEN NULL WHEN contains(s, ',') THEN 'RESULT' WHEN length(s) > 200 THEN 'OTHER' "
        "WHEN contains(s, '-') THEN 'OBJECTIVE' WHEN length(s) > 120 THEN 'METHOD' ELSE 'BACKGROUND' END")
LINES = {
    "lines": """SELECT doc_id, lang, text, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ls FROM documents""",
    "roles": f"SELECT *, list_transform(ls, lambda s: {ROLE}) AS labs FROM lines",
    "kept": """SELECT *, list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN coalesce(labs[i] IN ('RESULT', 'OTHER'), FALSE) THEN NULL ELSE ls[i] END),
  lambda s: s IS NOT NULL) AS k FROM roles""",
}
oracle("parse_labels", [],
       "SELECT doc_id, coalesce(array_to_string(list_transform(labs, lambda x: coalesce(x, '-')), ','), '') AS labels FROM roles", LINES)
oracle("kept_text", [],
       "SELECT doc_id AS citer_id, CAST(len(ls) AS INTEGER) AS n_sentences, md5(coalesce(array_to_string(k, ' '), '')) AS kept, len(k) = 0 AS emptied FROM kept", LINES)
WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''))"
COUNTERS = ("SELECT lang, count(*) AS units, " + ", ".join(f"CAST(sum({e}) AS BIGINT) AS {n}" for n, e in {
           "sentences": "len(ls)", "sentences_removed": "len(ls) - len(k)", "unlabelled_too_long": "(len(ls) > 120)::INT",
           "emptied": "(len(k) = 0)::INT", "one_sentence_left": "(len(k) = 1)::INT", "unchanged": "(len(k) = len(ls))::INT",
           "last_sentence_removed": "coalesce((labs[-1] IN ('RESULT', 'OTHER'))::INT, 0)",
           "words": WORDS.format("text"), "words_kept": WORDS.format("coalesce(array_to_string(k, ' '), '')"),
           **{f"label_{x}": f"len(list_filter(labs, lambda x: x = '{x}'))" for x in ("BACKGROUND", "OBJECTIVE", "METHOD", "RESULT", "OTHER")},
           "label_UNPARSED": "len(list_filter(labs, lambda x: x IS NULL))",
       }.items()) + " FROM kept GROUP BY 1")
oracle("removal_counters", [], COUNTERS, LINES)

# Sentences by corpus statistics.
def _core(x: str) -> str:
    bare = f"""lower(regexp_replace(regexp_replace(regexp_replace({x}, '^["''(\\[]+', ''), '["'')\\],;:!?]+$', ''), '\\.$', ''))"""
    return f"CASE WHEN regexp_matches({bare}, '^[0-9.,-]*[0-9]$') THEN '#' ELSE {bare} END"


def _fit(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)"


def _tie(both: str, left: str, right: str, whole: str) -> str:
    p, inside, outside = f"({right} / {whole})", f"({both} / {left})", f"(({right} - {both}) / ({whole} - {left}))"
    rest = (f"{right} - {both}", f"({whole} - {left})")
    ratio = " ".join([_fit(both, left, p), "+", _fit(f"({rest[0]})", rest[1], p), "-", _fit(both, left, inside), "-", _fit(f"({rest[0]})", rest[1], outside)])
    return f"CASE WHEN {inside} > {p} THEN -2 * ({ratio}) ELSE 0.0 END"


DOTS = "(length(word) - length(replace(word, '.', '')))"
LETTERS = f"(length(word) - {DOTS})"
TALK = {
    "texts": "SELECT doc_id, lang, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents",
    "places": "SELECT doc_id, i, w[i] AS word, w[i + 1] AS following FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts)",
    "seen": f"""SELECT doc_id, i, {_core('word')} AS f, {_core('following')} AS s,
  regexp_matches(word, '\\.["'')\\],;:!?]*$') AS stop, regexp_extract(word, '([.!?])["'')\\]]*$', 1) AS m,
  coalesce(regexp_matches(following, '^["''(\\[]*[\\p{{Lu}}0-9]'), FALSE) AS opening FROM places""",
    "stops": """SELECT f AS word, count(*) FILTER (WHERE stop) AS n_stop, count(*) FILTER (WHERE NOT stop) AS n_plain FROM seen WHERE f <> '' GROUP BY 1""",
    "overall": "SELECT sum(n_stop) / sum(n_stop + n_plain) AS chance FROM stops",
    "abbrevs": f"""SELECT word, n_stop, n_plain, CASE WHEN regexp_matches(word, '\\p{{L}}') THEN
  -2 * ({_fit('n_stop', '(n_stop + n_plain)', 'chance')} - {_fit('n_stop', '(n_stop + n_plain)', '0.99::DOUBLE')})
  * exp(-{LETTERS}) * ({DOTS} + 1) * pow({LETTERS}::DOUBLE, -n_plain) ELSE 0.0 END AS score FROM stops, overall WHERE n_stop > 0""",
    "judged": """SELECT *, stop AND (f IN (SELECT word FROM abbrevs WHERE score >= 0.3) OR regexp_matches(f, '^\\p{L}$')) AS short FROM seen""",
    "inner_pairs": "SELECT * FROM judged WHERE s IS NOT NULL AND s <> ''",
    "begins": """SELECT s AS word, count(*) FILTER (WHERE m <> '' AND opening AND NOT short AND (f <> '#' OR m <> '.')) AS n_after, count(*) AS n_all FROM inner_pairs GROUP BY 1""",
    "begun": f"""SELECT word, n_after, n_all, {_tie('n_after', 'ends', 'n_all', 'total')} AS ratio
  FROM begins, (SELECT sum(n_after) AS ends, sum(n_all) AS total FROM begins) WHERE n_after > 0""",
    "bound": "SELECT * FROM inner_pairs WHERE stop AND (short OR f = '#')",
    "tied": f"""SELECT f, s, n, {_tie('n', 'nf', 'ns', 'total')} AS ratio FROM (SELECT f, s, count(*) AS n FROM bound GROUP BY 1, 2)
  JOIN (SELECT f, count(*) AS nf FROM bound GROUP BY 1) USING (f) JOIN (SELECT s, count(*) AS ns FROM inner_pairs GROUP BY 1) USING (s),
  (SELECT count(*) AS total FROM inner_pairs) WHERE n >= 2""",
    "ending": """SELECT doc_id, i FROM judged j WHERE m <> '' AND opening AND NOT (m = '.' AND (short OR f = '#') AND (
    EXISTS (SELECT 1 FROM tied t WHERE t.f = j.f AND t.s = j.s AND t.ratio >= 7.88)
    OR (short AND NOT EXISTS (SELECT 1 FROM begun b WHERE b.word = j.s AND b.ratio >= 30))))""",
    "edges_of": "SELECT doc_id, list_sort(list(i)) AS cuts FROM ending GROUP BY 1",
    "lines": """SELECT doc_id, lang, text, list_filter(list_transform(range(1, len(e)), lambda k: array_to_string(w[e[k] + 1:e[k + 1]], ' ')), lambda x: x <> '') AS ls
  FROM (SELECT doc_id, lang, text, w, list_concat([0], coalesce(cuts, []), [len(w)]) AS e FROM texts LEFT JOIN edges_of USING (doc_id))""",
}
oracle("abbreviations", [], f"SELECT word, n_stop, n_plain, {r('score')} AS score FROM abbrevs", TALK)
oracle("sentence_starters", [], f"SELECT word, n_after, n_all, {r('ratio')} AS ratio FROM begun", TALK)
oracle("sentence_collocations", [], f"SELECT f AS first, s AS second, n, {r('ratio')} AS ratio FROM tied", TALK)
oracle("learned_sentences", [],
       "SELECT doc_id AS citer_id, CAST(len(ls) AS INTEGER) AS n_sentences, md5(array_to_string(ls, chr(10))) AS lines FROM lines", TALK)
oracle("learned_removal_counters", [], COUNTERS, {**TALK, **{n: LINES[n] for n in ("roles", "kept")}})
FLOOR = {**LINES, "left_pairs": "SELECT p.* FROM en_pairs p JOIN kept ON doc_id = citer_id WHERE len(k) > 0",
         "counts": """SELECT seed_id, count(*) AS n_before, count(*) FILTER (WHERE citer_id IN (SELECT citer_id FROM left_pairs)) AS n_left
FROM en_pairs GROUP BY 1"""}
oracle("refloored_pairs", ["en_pairs"],
       "SELECT l.seed_id, citer_id, n_left AS n_citers FROM left_pairs l JOIN counts USING (seed_id) WHERE n_left >= 5", FLOOR)
oracle("removal_totals", ["en_pairs"],
       """SELECT count(*) FILTER (WHERE n_left >= 5) AS seeds, CAST(coalesce(sum(n_left) FILTER (WHERE n_left >= 5), 0) AS BIGINT) AS pairs,
  CAST(sum(n_before - n_left) AS BIGINT) AS pairs_dropped_emptied, count(*) FILTER (WHERE n_left < 5) AS seeds_dropped_under_floor,
  CAST(coalesce(sum(n_left) FILTER (WHERE n_left < 5), 0) AS BIGINT) AS pairs_dropped_with_seed FROM counts""", FLOOR)

# ---- scoring

SCORES = {
    **VEC,
    "tgt": "SELECT seed_id, item_id AS citer_id, vec FROM vec WHERE is_target",
    "donor": """SELECT seed_id, coalesce(lead(seed_id) OVER (ORDER BY h), first_value(seed_id) OVER (ORDER BY h)) AS donor_id
FROM (SELECT DISTINCT seed_id, sha256('shuffle' || chr(9) || seed_id) AS h FROM tgt)""",
    "goal": """SELECT 'own' AS mode, * FROM tgt UNION ALL SELECT 'shuffled', d.seed_id, t.citer_id, t.vec FROM donor d JOIN tgt t ON t.seed_id = d.donor_id
WHERE NOT EXISTS (SELECT 1 FROM tgt o WHERE o.seed_id = d.seed_id AND o.citer_id = t.citer_id)""",
    "gen": "SELECT lang AS condition, seed_id, vec FROM vec WHERE NOT is_target AND lang IS NOT NULL",
    "scores": """SELECT g.condition, t.mode, t.seed_id, t.citer_id, any_value(c.year) AS citer_year, any_value(c.publicationdate) AS citer_pubdate,
  CAST(count(*) AS INTEGER) AS n_gen, max(list_dot_product(t.vec, g.vec)) AS best_cos
FROM goal t JOIN gen g ON g.seed_id = t.seed_id LEFT JOIN citing_papers c ON c.corpusid = t.citer_id GROUP BY 1, 2, 3, 4""",
    "sides": """SELECT *, CASE WHEN citer_pubdate >= '1995-06-01' THEN 'post' WHEN citer_pubdate IS NOT NULL THEN 'pre'
  WHEN citer_year < 1995 AND citer_year <> 0 THEN 'pre' END AS side FROM scores""",
}
oracle("pair_scores", ["citing_papers"],
       f"SELECT condition, mode, seed_id, citer_id, CAST(citer_year AS INTEGER) AS citer_year, citer_pubdate, n_gen, {r('best_cos')} AS best_cos FROM scores", SCORES)
STRATA = {**SCORES, "st": """SELECT *, 'all' AS stratum FROM sides UNION ALL SELECT *, side || '_cutoff' FROM sides WHERE side IS NOT NULL
UNION ALL SELECT *, 'year ' || CASE WHEN citer_year < 2015 THEN '<=2014' ELSE CAST(citer_year AS VARCHAR) END FROM sides WHERE coalesce(citer_year, 0) <> 0"""}
oracle("score_strata", ["citing_papers"],
       f"""SELECT condition, mode, stratum, count(*) AS n_pairs, count(DISTINCT seed_id) AS n_seeds, {r('avg(best_cos)')} AS coverage FROM st GROUP BY 1, 2, 3""",
       STRATA)
SUMMARY_KEY = "concat_ws(chr(9), condition, mode, stratum, metric)"
SUMMARY_PARTS = ", ".join(f"split_part(cell_key, chr(9), {i}) AS {name}" for i, name in enumerate(("condition", "mode", "stratum", "metric"), 1))
oracle("score_summary", ["citing_papers"], f"SELECT {SUMMARY_PARTS}, mean, ci_low, ci_high FROM ({boot_sql('cell_key')})", {**STRATA, **boot(
    f"""SELECT {SUMMARY_KEY} AS cell_key, seed_id AS u, CASE WHEN metric = 'cosine_coverage' THEN coalesce(sum(best_cos), 0) ELSE 0 END::DOUBLE AS total,
  CASE WHEN metric = 'cosine_coverage' THEN count(best_cos) ELSE 0 END::DOUBLE AS cnt
FROM st, (SELECT unnest(['cosine_coverage', {', '.join(f"'recall@{k}'" for k in K_HEADLINE)}]) AS metric) GROUP BY condition, mode, stratum, metric, seed_id""", "cell_key")})
oracle("undated_pairs", ["citing_papers"],
       "SELECT condition, mode, count(*) FILTER (WHERE side IS NULL) AS n_pairs_undated FROM sides GROUP BY 1, 2", SCORES)

# ---- ingestion

oracle("paper_records", [],
       """SELECT p_partkey AS corpusid, CASE WHEN p_type <> 'ECONOMY' THEN p_type || '-' || p_partkey END AS acl_id, p_brand AS doi,
  CAST(NULL AS VARCHAR) AS arxiv, p_name AS title,
  CASE WHEN p_size > 10 THEN p_name || '|' || p_brand WHEN p_size > 5 THEN p_name END AS authors, p_size AS year,
  CASE WHEN p_size <= 25 THEN p_type END AS venue, p_brand AS journal_name, array_to_string(list_sort([p_type, p_brand]), '|') AS fields FROM part""")
oracle("bucket_counts", ["raw_edges"],
       "SELECT CAST(((citedcorpusid - 1000) % 64 + 64) % 64 AS INTEGER) AS bucket, count(*) AS n FROM raw_edges GROUP BY 1")
oracle("embed_cache_misses", [],
       """SELECT DISTINCT sha256(text) AS text_key, CAST(length(text) AS INTEGER) AS n_chars FROM documents
WHERE text NOT IN (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)""")

# The cleaning rules again, in RE2 syntax.
CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', ''),
  '(?i)^\**title\**\s*:[^\n]*\n+', ''), '^\*\*[^\n]*\*\*[ \t]*\n\s*', ''), '(?i)^\**\s*(?:abstract|proposal)\s*\**[ \t]*(?:[:\-–—]\s*\**\s*|\n\s*)', ''),
  '\*\*(.+?)\*\*', '\1', 'g')"""
oracle("clean_output", [],
       "SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS answer FROM (SELECT doc_id, " + TRIM.format(
           "regexp_replace(regexp_replace(" + TRIM.format(CLEAN.format("a")) + r""", '^"+', ''), '"+$', '')""") + " AS t FROM answers)", REPLIES)

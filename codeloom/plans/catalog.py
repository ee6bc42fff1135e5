"""The registered queries of the coding operators, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import kernels, names, providers, texts, udfs
from codeloom.operators import agreement, checks, clustering, codebook, eventlog, growth, lexical, occurrence, organise, segments, similarity, withheld
from codeloom.plans import loop, timeline, validation
from codeloom.sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# relations that the SQL of several queries starts from
A = "a AS (SELECT DISTINCT user_id AS response_id, event_type || '-k' || json_extract_string(props, '$.k') AS code FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)"
B = "a AS (SELECT DISTINCT l_orderkey AS response_id, p_brand || '-' || p_type AS code FROM lineitem JOIN part ON l_partkey = p_partkey)"
FREQ = "f AS (SELECT code, count(*) AS n_responses FROM a GROUP BY code), u AS (SELECT count(DISTINCT response_id) AS n FROM a)"
BATCHES = "b AS (SELECT response_id, (row_number() OVER (ORDER BY response_id) - 1) // 10 + 1 AS batch FROM (SELECT DISTINCT response_id FROM a))"
CURVE = f"""{BATCHES}, first AS (SELECT code, min(batch) AS batch FROM a JOIN b USING (response_id) GROUP BY code), fresh AS (SELECT batch, count(*) AS n FROM first GROUP BY batch),
size AS (SELECT batch, count(*) AS responses_in_batch FROM b GROUP BY batch),
g AS (SELECT batch, responses_in_batch, CAST(sum(responses_in_batch) OVER (ORDER BY batch) AS BIGINT) AS cumulative_responses, coalesce(n, 0) AS new_codes, CAST(sum(coalesce(n, 0)) OVER (ORDER BY batch) AS BIGINT) AS cumulative_codes FROM size LEFT JOIN fresh USING (batch))"""
CODES = """leaf AS (SELECT lower(replace(p_brand, '#', '')) AS b, lower(p_type) AS t, min(p_size) AS s, min(p_name) AS d FROM part GROUP BY 1, 2),
c AS (SELECT 'c-' || b || '-' || t AS code_id, b || '-' || t || CASE WHEN s = 1 THEN ' x' ELSE '' END AS name, CASE WHEN s < 3 THEN '' ELSE d END AS description, 'p-' || b AS parent_id FROM leaf
UNION ALL SELECT DISTINCT 'p-' || b, b, 'a brand', CAST(NULL AS VARCHAR) FROM leaf WHERE CAST(substr(b, 6) AS INTEGER) < 23)"""
EVIDENCE = """e AS (SELECT CASE WHEN l_linenumber = 7 THEN 'p-' || lower(replace(p_brand, '#', '')) ELSE 'c-' || lower(replace(p_brand, '#', '')) || '-' || lower(p_type) END AS code_id, l_orderkey AS response_id, p_name AS quote, l_returnflag <> 'N' AS verified FROM lineitem JOIN part ON l_partkey = p_partkey)"""
HUMAN = "h AS (SELECT DISTINCT * FROM (SELECT doc_id AS response_id, 'quality-good' AS code FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'tone-toxic' FROM labels WHERE toxic = 1))"
MACHINE = "m AS (SELECT DISTINCT * FROM (SELECT doc_id AS response_id, 'quality-good' AS code FROM documents WHERE length(text) >= 200 UNION ALL SELECT doc_id, 'tone-toxic' FROM documents WHERE instr(text, '!') > 0 UNION ALL SELECT doc_id, 'form-table' FROM documents WHERE instr(text, '|') > 0))"
CELLS = f"{HUMAN}, {MACHINE}, x AS (SELECT coalesce(h.response_id, m.response_id) AS response_id, coalesce(h.code, m.code) AS code, CASE WHEN h.code IS NULL THEN 0 ELSE 1 END AS h, CASE WHEN m.code IS NULL THEN 0 ELSE 1 END AS m FROM h FULL JOIN m ON h.response_id = m.response_id AND h.code = m.code)"
LOG = """l AS (SELECT user_id AS run_id, event_id, CASE event_type WHEN 'signup' THEN 'response_prepared' WHEN 'purchase' THEN 'checkpoint_evaluated' WHEN 'error' THEN 'judge_consulted' WHEN 'click' THEN 'code_created' WHEN 'view' THEN 'code_merged' END AS event,
CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) ELSE 'code-' || json_extract_string(props, '$.k') END AS subject, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _occ(spark, d):
    return occurrence.occurrence(t.assignments(spark, d))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- occurrence -----------------------------------------------------------------------------------------------


@query(f"WITH {A} SELECT response_id, code FROM a")
def occurrence_relation(spark, d):
    return _occ(spark, d)


@query(f"WITH {A} SELECT o_custkey AS response_id, code FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN a ON o_custkey = response_id")
def occurrence_matrix(spark, d):
    universe = t.table(spark, d, "orders").select(F.col("o_custkey").alias("response_id"))
    return occurrence.build_matrix(universe, t.assignments(spark, d))


@query(f"WITH {A} SELECT DISTINCT response_id FROM a WHERE response_id NOT IN (SELECT o_custkey FROM orders)")
def unknown_responses(spark, d):
    return occurrence.unknown_responses(t.table(spark, d, "orders").select(F.col("o_custkey").alias("response_id")), t.assignments(spark, d))


@query(f"WITH {A} SELECT code, count(*) AS n_responses FROM a GROUP BY code")
def code_frequencies(spark, d):
    return occurrence.frequencies(_occ(spark, d))


@query(f"WITH {A} SELECT response_id, count(*) AS n_codes FROM a GROUP BY response_id")
def codes_per_response(spark, d):
    return occurrence.codes_per_response(_occ(spark, d))


@query(f"WITH {A}, {FREQ}, th AS (SELECT greatest(2, CAST(ceil(0.13 * n - 1e-9) AS BIGINT)) AS t FROM u) SELECT code, n_responses, t AS threshold, n_responses >= t AS kept, CASE WHEN n_responses >= t THEN '' WHEN n_responses < 2 THEN 'absolute' ELSE 'fraction' END AS reason FROM f, th")
def frequency_filter(spark, d):
    return occurrence.frequency_filter(_occ(spark, d), 2, 0.13)


@query(f"WITH {A}, {FREQ} SELECT response_id, a.code FROM a JOIN f ON a.code = f.code WHERE n_responses >= 12")
def filtered_occurrence(spark, d):
    return occurrence.filtered(_occ(spark, d), 12)


@query(f"WITH {A} SELECT DISTINCT response_id, split_part(code, '-', 1) AS code FROM a")
def family_occurrence(spark, d):
    return occurrence.family_occurrence(_occ(spark, d))


@query(f"WITH {A}, {FREQ}, p AS (SELECT x.code AS code_a, y.code AS code_b, count(*) AS n_both FROM a x JOIN a y USING (response_id) WHERE x.code <= y.code GROUP BY 1, 2) SELECT code_a, code_b, n_both, round(CASE WHEN code_a = code_b THEN 1.0::DOUBLE ELSE n_both / (fa.n_responses + fb.n_responses - n_both) END, 6) AS jaccard FROM p JOIN f fa ON fa.code = code_a JOIN f fb ON fb.code = code_b")
def cooccurrence_jaccard(spark, d):
    return _rounded(occurrence.cooccurrence(_occ(spark, d)), "jaccard")


@query(f"WITH {B}, ff AS (SELECT DISTINCT response_id, split_part(code, '-', 1) AS code FROM a), f AS (SELECT code, count(*) AS n FROM ff GROUP BY code), p AS (SELECT x.code AS code_a, y.code AS code_b, count(*) AS n_both FROM ff x JOIN ff y USING (response_id) WHERE x.code <= y.code GROUP BY 1, 2) SELECT code_a, code_b, n_both, round(CASE WHEN code_a = code_b THEN 1.0::DOUBLE ELSE n_both / (fa.n + fb.n - n_both) END, 6) AS jaccard FROM p JOIN f fa ON fa.code = code_a JOIN f fb ON fb.code = code_b")
def family_cooccurrence(spark, d):
    return _rounded(occurrence.cooccurrence(occurrence.family_occurrence(occurrence.occurrence(t.baskets(spark, d)))), "jaccard")


PAIRS = "pr AS (SELECT x.code AS code_a, y.code AS code_b, count(*) AS support FROM a x JOIN a y USING (response_id) WHERE x.code < y.code GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(f"WITH {A}, {FREQ}, {PAIRS} SELECT code_a, code_b, support, round(support / n, 6) AS share, (support / n) / ((fa.n_responses / n) * (fb.n_responses / n)) AS lift FROM pr JOIN f fa ON fa.code = code_a JOIN f fb ON fb.code = code_b, u")
def pair_cooccurrence(spark, d):
    return _rounded(occurrence.frequent_pairs(_occ(spark, d), 2), "share")


@query(f"WITH {B}, {FREQ}, {PAIRS} SELECT code_a, code_b, support, round(support / n, 6) AS share, (support / n) / ((fa.n_responses / n) * (fb.n_responses / n)) AS lift FROM pr JOIN f fa ON fa.code = code_a JOIN f fb ON fb.code = code_b, u")
def basket_pairs(spark, d):
    return _rounded(occurrence.frequent_pairs(occurrence.occurrence(t.baskets(spark, d)), 2), "share")


@query(f"""WITH {B}, {FREQ}, {PAIRS}, cand AS (SELECT ab.code_a, ab.code_b, ac.code_b AS code_c, least(ab.support, ac.support, bc.support) AS bound FROM pr ab JOIN pr ac ON ab.code_a = ac.code_a AND ab.code_b < ac.code_b JOIN pr bc ON bc.code_a = ab.code_b AND bc.code_b = ac.code_b ORDER BY bound DESC, 1, 2, 3 LIMIT 20000),
s AS (SELECT code_a, code_b, code_c, count(*) AS support FROM cand JOIN a x ON x.code = code_a JOIN a y ON y.code = code_b AND y.response_id = x.response_id JOIN a z ON z.code = code_c AND z.response_id = x.response_id GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT code_a, code_b, code_c, support, round(support / n, 6) AS share, (support / n) / ((fa.n_responses / n) * (fb.n_responses / n) * (fc.n_responses / n)) AS lift FROM s JOIN f fa ON fa.code = code_a JOIN f fb ON fb.code = code_b JOIN f fc ON fc.code = code_c, u""")
def basket_triples(spark, d):
    return _rounded(occurrence.frequent_triples(occurrence.occurrence(t.baskets(spark, d)), 2), "share")


SIGNATURE = "sg AS (SELECT response_id, string_agg(code, '|' ORDER BY code) AS signature FROM (SELECT DISTINCT response_id, split_part(code, '-', 1) AS code FROM a) GROUP BY response_id)"


@query(f"WITH {A}, {SIGNATURE} SELECT response_id, signature FROM sg")
def family_signatures(spark, d):
    return occurrence.signatures(_occ(spark, d))


@query(f"WITH {B}, {SIGNATURE} SELECT signature, count(*) AS size, min(response_id) AS first_response FROM sg GROUP BY signature HAVING count(*) >= 2")
def signature_groups(spark, d):
    return occurrence.signature_groups(occurrence.occurrence(t.baskets(spark, d)))


@query(f"WITH {B}, {SIGNATURE} SELECT min(response_id) AS response_id, signature FROM sg GROUP BY signature HAVING count(*) = 1")
def signature_singletons(spark, d):
    return occurrence.singletons(occurrence.occurrence(t.baskets(spark, d)))


@query(f"""WITH {A}, s AS (SELECT response_id, count(*) AS n FROM a GROUP BY 1), p AS (SELECT x.response_id, y.response_id AS mate, count(*) AS k FROM a x JOIN a y USING (code) WHERE x.response_id % 100 = 0 AND x.response_id <> y.response_id GROUP BY 1, 2),
j AS (SELECT p.response_id, mate, k / (sx.n + sy.n - k) AS jaccard FROM p JOIN s sx ON sx.response_id = p.response_id JOIN s sy ON sy.response_id = mate), r AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY jaccard DESC, mate) AS rank FROM j)
SELECT response_id, mate, round(jaccard, 6) AS jaccard, rank FROM r WHERE rank <= 5""")
def nearest_mates(spark, d):
    """A search: its queries are the responses whose id is divisible by 100, against all."""
    occ = _occ(spark, d)
    return _rounded(occurrence.nearest_mates(occ, 5, occ.where("response_id % 100 = 0")), "jaccard")


@query(f"WITH {A}, lab AS (SELECT response_id, min(split_part(code, '-', 1)) AS cluster FROM a GROUP BY 1) SELECT cluster, coalesce(c_mktsegment, '(missing)') AS value, count(*) AS n FROM lab LEFT JOIN customer ON c_custkey = response_id GROUP BY 1, 2")
def metadata_crosstab(spark, d):
    labels = _occ(spark, d).groupBy("response_id").agg(F.min(names.family_of("code")).alias("cluster"))
    return occurrence.metadata_crosstab(labels, t.table(spark, d, "customer").select(F.col("c_custkey").alias("response_id"), F.col("c_mktsegment").alias("value")))


@query(f"WITH {A}, lab AS (SELECT response_id, count(*) AS n FROM a GROUP BY 1), cl AS (SELECT response_id, CASE WHEN n >= 60 THEN 'many' ELSE 'few' END AS cluster FROM lab), sz AS (SELECT cluster, count(*) AS size FROM cl GROUP BY 1), hit AS (SELECT cluster, code, count(*) AS k FROM cl JOIN a USING (response_id) GROUP BY 1, 2) SELECT cluster, code, coalesce(k, 0) AS n, round(coalesce(k, 0) / size, 6) AS mean, coalesce(k, 0) / size >= 0.4 AS prominent FROM sz CROSS JOIN (SELECT DISTINCT code FROM a) LEFT JOIN hit USING (cluster, code)")
def cluster_means(spark, d):
    occ = _occ(spark, d)
    labels = occurrence.codes_per_response(occ).select("response_id", F.when(F.col("n_codes") >= 60, "many").otherwise("few").alias("cluster"))
    return _rounded(occurrence.cluster_means(occ, labels), "mean")


# ---- growth ---------------------------------------------------------------------------------------------------


@query(f"WITH {A}, {CURVE} SELECT *, round(new_codes / responses_in_batch, 6) AS new_codes_per_response FROM g")
def growth_curve(spark, d):
    occ = _occ(spark, d)
    return _rounded(growth.growth(occ, growth.batches(occ, 10)), "new_codes_per_response")


@query(f"WITH {A}, {CURVE} SELECT min(batch) FILTER (WHERE new_codes = 0) AS saturated_at_batch FROM g")
def saturation_point(spark, d):
    occ = _occ(spark, d)
    return growth.saturated_at(growth.growth(occ, growth.batches(occ, 10)))


@query(f"WITH {A}, {BATCHES} SELECT response_id, batch FROM b")
def response_batches(spark, d):
    return growth.batches(_occ(spark, d), 10)


MONTHS = "a AS (SELECT DISTINCT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS batch, o_custkey AS name FROM orders)"


@query(f"WITH {MONTHS}, f AS (SELECT name, min(batch) AS batch FROM a GROUP BY 1), n AS (SELECT batch, count(*) AS k FROM f GROUP BY 1), s AS (SELECT batch, count(*) AS codes_seen FROM a GROUP BY 1), x AS (SELECT batch, codes_seen, coalesce(k, 0) AS new_codes, CAST(sum(coalesce(k, 0)) OVER (ORDER BY batch) AS BIGINT) AS cumulative_unique FROM s LEFT JOIN n USING (batch)) SELECT *, round(new_codes / cumulative_unique, 6) AS growth_rate, new_codes - coalesce(lag(new_codes) OVER (ORDER BY batch), 0) AS new_codes_delta FROM x")
def snapshot_saturation(spark, d):
    """Months as batches, customers as names."""
    seen = t.table(spark, d, "orders").select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("batch"), F.col("o_custkey").alias("name")).distinct()
    return growth.snapshot_saturation(seen)


DAYS = "g AS (SELECT CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS batch, count(*) AS new_codes FROM orders GROUP BY 1)"


@query(f"WITH {DAYS}, w AS (SELECT batch, new_codes, quantile_cont(new_codes, 0.5) OVER (ORDER BY batch ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS baseline, row_number() OVER (ORDER BY batch) AS k FROM g) SELECT batch, new_codes, CAST(baseline AS DOUBLE) AS baseline, CASE WHEN baseline > 0 THEN round(new_codes / baseline, 6) END AS ratio FROM w WHERE k > 3 AND new_codes >= 4 AND new_codes >= 2.0 * baseline")
def spike_rule(spark, d):
    """Orders per day as the series."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint")
    return growth.spikes(t.table(spark, d, "orders").groupBy(day.alias("batch")).agg(F.count(F.lit(1)).alias("new_codes")))


@query(f"""WITH {LOG}, prep AS (SELECT CAST(subject AS BIGINT) AS response_id, min(event_id) AS event_id FROM l WHERE event = 'response_prepared' GROUP BY 1), b AS (SELECT response_id, (row_number() OVER (ORDER BY event_id) - 1) // 10 + 1 AS batch FROM prep),
a AS (SELECT DISTINCT k AS response_id, subject AS code FROM l WHERE event = 'code_created'), first AS (SELECT code, min(batch) AS batch FROM a JOIN b USING (response_id) GROUP BY code), fresh AS (SELECT batch, count(*) AS n FROM first GROUP BY batch), size AS (SELECT batch, count(*) AS responses_in_batch FROM b GROUP BY batch)
SELECT batch, responses_in_batch, CAST(sum(responses_in_batch) OVER (ORDER BY batch) AS BIGINT) AS cumulative_responses, coalesce(n, 0) AS new_codes, CAST(sum(coalesce(n, 0)) OVER (ORDER BY batch) AS BIGINT) AS cumulative_codes, round(coalesce(n, 0) / responses_in_batch, 6) AS new_codes_per_response FROM size LEFT JOIN fresh USING (batch)""")
def growth_from_audit(spark, d):
    return _rounded(growth.growth_from_audit(t.audit(spark, d), 10), "new_codes_per_response")


# ---- agreement ------------------------------------------------------------------------------------------------

PRF = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r"


@query(f"""WITH {CELLS}, c AS (SELECT CAST(count(DISTINCT code) AS BIGINT) AS n_codes, CAST(sum(h * m) AS BIGINT) AS tp, CAST(sum((1 - h) * m) AS BIGINT) AS fp, CAST(sum(h * (1 - m)) AS BIGINT) AS fn FROM x), n AS (SELECT count(DISTINCT response_id) AS n_responses FROM x),
y AS (SELECT *, n_responses * n_codes - tp - fp - fn AS tn FROM c, n), z AS (SELECT *, {PRF}, (tp + tn) / (tp + fp + fn + tn) AS po, ((tp + fp)::DOUBLE * (tp + fn) + (fn + tn)::DOUBLE * (fp + tn)) / ((tp + fp + fn + tn)::DOUBLE * (tp + fp + fn + tn)) AS pe FROM y)
SELECT n_responses, n_codes, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM z""")
def coding_agreement(spark, d):
    return agreement.scores(t.human(spark, d), t.machine(spark, d))


@query(f"WITH {CELLS}, c AS (SELECT code, CAST(sum(h) AS BIGINT) AS human_n, CAST(sum(m) AS BIGINT) AS machine_n, CAST(sum(h * m) AS BIGINT) AS tp, CAST(sum((1 - h) * m) AS BIGINT) AS fp, CAST(sum(h * (1 - m)) AS BIGINT) AS fn FROM x GROUP BY code) SELECT code, human_n, machine_n, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c")
def agreement_per_code(spark, d):
    return agreement.per_code(t.human(spark, d), t.machine(spark, d))


@query(f"WITH {CELLS} SELECT response_id, code, h, m FROM x")
def agreement_cells(spark, d):
    return agreement.cells(t.human(spark, d), t.machine(spark, d))


@query(f"WITH {HUMAN}, {MACHINE} SELECT code, count(*) AS n_assignments, count(DISTINCT response_id) AS n_responses FROM m WHERE code NOT IN (SELECT code FROM h) GROUP BY code")
def over_coding(spark, d):
    return agreement.unmatched_codes(t.machine(spark, d), t.human(spark, d))


@query(f"WITH {HUMAN}, {B} SELECT code, count(*) AS n_assignments, count(DISTINCT response_id) AS n_responses FROM a WHERE code NOT IN (SELECT code FROM h) GROUP BY code")
def blind_spots(spark, d):
    return agreement.unmatched_codes(occurrence.occurrence(t.baskets(spark, d)), t.human(spark, d))


SPANS = "s AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_orderkey AS response_id, l_linestatus AS code, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS b, l_returnflag AS flag FROM lineitem)"
OVERLAP = "o AS (SELECT x.row_id, x.flag, max(CASE WHEN y.row_id IS NULL THEN NULL WHEN (x.b - x.a) + (y.b - y.a) - greatest(0, least(x.b, y.b) - greatest(x.a, y.a)) > 0 THEN greatest(0, least(x.b, y.b) - greatest(x.a, y.a)) / ((x.b - x.a) + (y.b - y.a) - greatest(0, least(x.b, y.b) - greatest(x.a, y.a))) ELSE 0 END) AS v FROM s x LEFT JOIN s y ON x.response_id = y.response_id AND x.code = y.code AND ((x.flag = 'A' AND y.flag = 'R') OR (x.flag = 'R' AND y.flag = 'A')) WHERE x.flag IN ('A', 'R') GROUP BY 1, 2)"


@query(f"WITH {SPANS}, {OVERLAP} SELECT row_id, round(coalesce(v, 0), 6) AS overlap, v IS NOT NULL AS shares_code FROM o WHERE flag = 'A'")
def segment_overlaps(spark, d):
    return _rounded(agreement.segment_overlaps(t.spans(spark, d, "A"), t.spans(spark, d, "R")), "overlap")


@query(f"""WITH {SPANS}, {OVERLAP}, z AS (SELECT flag, count(*) AS n, avg(coalesce(v, 0)) AS w, avg(CASE WHEN coalesce(v, 0) >= 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS t, count(*) FILTER (WHERE v IS NOT NULL AND v < 0.5) AS wrong FROM o GROUP BY flag)
SELECT h.n AS n_human, m.n AS n_machine, round(m.w, 6) AS weighted_precision, round(h.w, 6) AS weighted_recall, round(2 * m.w * h.w / (m.w + h.w), 6) AS weighted_f1, round(m.t, 6) AS strict_precision, round(h.t, 6) AS strict_recall, round(2 * m.t * h.t / (m.t + h.t), 6) AS strict_f1, m.wrong AS right_code_wrong_place FROM z h, z m WHERE h.flag = 'A' AND m.flag = 'R'""")
def segment_agreement(spark, d):
    return agreement.segment_agreement(t.spans(spark, d, "A"), t.spans(spark, d, "R"))


GRID = [round(k * 0.05, 2) for k in range(21)]


@query(f"""WITH units AS (SELECT least(1.0::DOUBLE, n_chars / 4000) AS score, toxic = 1 AS label FROM documents JOIN labels USING (doc_id)), g AS (SELECT unnest({GRID})::DOUBLE AS threshold),
c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label) AS tp, count(*) FILTER (WHERE score >= threshold AND NOT label) AS fp, count(*) FILTER (WHERE score < threshold AND label) AS fn, count(*) FILTER (WHERE score < threshold AND NOT label) AS tn FROM g, units GROUP BY 1)
SELECT threshold, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""")
def threshold_sweep(spark, d):
    units = t.table(spark, d, "documents").select("doc_id", "n_chars").join(t.table(spark, d, "labels"), "doc_id").select(F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("score"), (F.col("toxic") == 1).alias("label"))
    return agreement.sweep(units, GRID, predict_below=False)


@query("SELECT CASE WHEN v >= 0.8 THEN 'MERGE' WHEN v < 0.45 THEN 'CREATE' ELSE 'JUDGE' END AS route, count(*) AS n FROM (SELECT l_discount * 10 AS v FROM lineitem) GROUP BY 1")
def routing_bands(spark, d):
    return t.table(spark, d, "lineitem").select(texts.route(F.col("l_discount") * 10, 0.8, 0.45).alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


# ---- codebook -------------------------------------------------------------------------------------------------


@query(f"WITH {CODES} SELECT code_id, name, description, parent_id FROM c WHERE code_id NOT IN (SELECT parent_id FROM c WHERE parent_id IS NOT NULL)")
def codebook_leaves(spark, d):
    return codebook.leaves(t.codebook(spark, d)).select("code_id", "name", "description", "parent_id")


@query(f"WITH {CODES} SELECT split_part(name, '-', 1) AS family, count(*) AS size, string_agg(name, '|' ORDER BY name) AS members FROM c GROUP BY 1")
def codebook_families(spark, d):
    return codebook.families(t.codebook(spark, d))


@query(f"WITH {CODES}, s AS (SELECT DISTINCT split_part(name, '-', 1) AS family, CASE WHEN instr(name, '-') > 0 THEN substr(name, instr(name, '-') + 1) ELSE '' END AS sub FROM c) SELECT family, coalesce(string_agg(sub, '|' ORDER BY sub) FILTER (WHERE sub <> ''), '') AS subs FROM s GROUP BY 1")
def hierarchy_skeleton(spark, d):
    return codebook.skeleton(t.codebook(spark, d))


@query(f"WITH {CODES}, {EVIDENCE} SELECT response_id, quote AS segment, name AS code FROM e JOIN c USING (code_id) WHERE verified")
def assignments_from_codebook(spark, d):
    return codebook.assignments_of(t.evidence(spark, d), t.codebook(spark, d))


@query(f"WITH {CODES}, {EVIDENCE} SELECT name, count(DISTINCT response_id) FILTER (WHERE verified) AS n_responses FROM c LEFT JOIN e USING (code_id) GROUP BY code_id, name")
def code_usage(spark, d):
    return codebook.usage(t.evidence(spark, d), t.codebook(spark, d))


@query(f"WITH {CODES}, s AS (SELECT DISTINCT split_part(name, '-', 1) AS family, substr(name, instr(name, '-') + 1) AS sub FROM c WHERE instr(name, '-') > 0) SELECT sub, count(*) AS n_families, string_agg(family, '|' ORDER BY family) AS families FROM s GROUP BY sub HAVING count(*) >= 2")
def cross_family_subcodes(spark, d):
    return codebook.cross_family_subs(t.codebook(spark, d))


@query(f"WITH {CODES} SELECT c.code_id, CASE WHEN p.code_id IS NULL THEN 1 ELSE 2 END::BIGINT AS depth, false AS cyclic FROM c LEFT JOIN c p ON c.parent_id = p.code_id")
def parent_chains(spark, d):
    return codebook.chains(t.codebook(spark, d))


@query(f"""WITH {CODES}, {EVIDENCE}, f AS (
SELECT 'ERROR' AS severity, 'duplicate_name' AS marker, min(name) AS subject FROM c GROUP BY lower(trim(name)) HAVING count(*) > 1
UNION ALL SELECT 'ERROR', 'orphan_parent', name FROM c WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT code_id FROM c)
UNION ALL SELECT 'INFO', 'evidence_on_parent', name FROM c WHERE code_id IN (SELECT parent_id FROM c WHERE parent_id IS NOT NULL) AND code_id IN (SELECT code_id FROM e)
UNION ALL SELECT 'WARN', 'missing_description', name FROM c WHERE trim(coalesce(description, '')) = ''
UNION ALL SELECT 'ERROR', 'evidence_response_missing', name FROM c WHERE code_id IN (SELECT code_id FROM e WHERE response_id NOT IN (SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END FROM orders))
UNION ALL SELECT 'WARN', 'name_grammar', name FROM c WHERE code_id NOT IN (SELECT parent_id FROM c WHERE parent_id IS NOT NULL) AND (regexp_matches(name, '\\s') OR NOT regexp_full_match(name, '[a-z0-9]+([_-][a-z0-9]+)*')))
SELECT 'S6' AS check_id, severity, marker, subject FROM f""")
def codebook_checks(spark, d):
    # pending orders have an id that no evidence names
    ids = t.table(spark, d, "orders").select(F.expr("CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END").alias("response_id"))
    found = codebook.check_codebook(t.codebook(spark, d), t.evidence(spark, d), ids)
    return found.select("check_id", "severity", F.get_json_object("data", "$.marker").alias("marker"), "subject")


@query(f"WITH {CODES}, s AS (SELECT count(*)::DOUBLE AS v FROM c GROUP BY split_part(name, '-', 1)), r AS (SELECT v, row_number() OVER (ORDER BY v) AS k FROM s) SELECT round(2 * sum(k * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) AS gini FROM r")
def family_gini(spark, d):
    return codebook.gini(codebook.families(t.codebook(spark, d)))


@query(f"WITH {CODES}, {EVIDENCE}, k AS (SELECT code_id, count(e.code_id) FILTER (WHERE verified) AS k FROM c LEFT JOIN e USING (code_id) GROUP BY code_id) SELECT count(*) AS n_codes, CAST(sum(k) AS BIGINT) AS total, round(avg(k), 6) AS mean, round(quantile_cont(k, 0.5), 6) AS median, min(k) AS minimum, max(k) AS maximum, round(quantile_cont(k, 0.25), 6) AS p25, round(quantile_cont(k, 0.75), 6) AS p75, count(*) FILTER (WHERE k = 0) AS zero_evidence_codes FROM k")
def evidence_distribution(spark, d):
    return codebook.evidence_distribution(t.codebook(spark, d), t.evidence(spark, d))


@query(f"""WITH {CODES}, {EVIDENCE}, fam AS (SELECT count(*) AS v FROM c GROUP BY split_part(name, '-', 1)), leafs AS (SELECT count(*) AS n FROM c WHERE code_id NOT IN (SELECT parent_id FROM c WHERE parent_id IS NOT NULL)), orph AS (SELECT count(*) AS n FROM c WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT code_id FROM c)), tot AS (SELECT count(*) AS n FROM c)
SELECT tot.n AS n_codes, (SELECT count(*) FROM fam) AS n_families, leafs.n AS n_leaves, tot.n - leafs.n AS n_parents, orph.n AS n_orphans, round(leafs.n / tot.n, 6) AS leaf_ratio, round(orph.n / tot.n, 6) AS orphan_ratio, round((SELECT max(v) FROM fam) / tot.n, 6) AS largest_family_share FROM tot, leafs, orph""")
def codebook_health(spark, d):
    x = codebook.health(t.codebook(spark, d), t.evidence(spark, d))
    return x.select("n_codes", "n_families", "n_leaves", "n_parents", "n_orphans", "leaf_ratio", "orphan_ratio", "largest_family_share")


DIFF = "v AS (SELECT DISTINCT p_brand || '-' || CAST(p_size % 7 AS VARCHAR) AS name FROM part), w AS (SELECT DISTINCT p_brand || '-' || CAST(p_size % 5 * 2 AS VARCHAR) AS name FROM part)"


@query(f"WITH {DIFF} SELECT name, 'added' AS change FROM w WHERE name NOT IN (SELECT name FROM v) UNION ALL SELECT name, 'removed' FROM v WHERE name NOT IN (SELECT name FROM w)")
def snapshot_diff(spark, d):
    side = lambda number: t.table(spark, d, "part").select(F.concat("p_brand", F.lit("-"), number.cast("string")).alias("name"))
    return codebook.snapshot_diff(side(F.col("p_size") % 7), side(F.col("p_size") % 5 * 2))


@query("WITH a AS (SELECT l_orderkey AS response_id, l_shipmode AS quote, count(*) AS n FROM (SELECT l_orderkey, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1, 2), b AS (SELECT l_orderkey AS response_id, CASE WHEN l_returnflag = 'R' THEN 'moved' ELSE l_linestatus END AS quote, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT coalesce(a.response_id, b.response_id) AS response_id, coalesce(a.quote, b.quote) AS quote, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after, CASE WHEN a.n IS NULL THEN 'invented' WHEN coalesce(b.n, 0) < a.n THEN 'lost' ELSE 'multiplied' END AS problem FROM a FULL JOIN b ON a.response_id = b.response_id AND a.quote = b.quote WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def evidence_conserved(spark, d):
    side = lambda quote: t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("response_id"), quote.alias("quote"))
    return codebook.evidence_conserved(side(F.col("l_linestatus")), side(F.when(F.col("l_returnflag") == "R", "moved").otherwise(F.col("l_linestatus"))))


@query("SELECT DISTINCT l_orderkey AS response_id, l_linenumber * 10 AS start, l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS \"end\", 'line ' || l_linenumber AS quote FROM lineitem")
def merge_evidence(spark, d):
    side = lambda flag: t.spans(spark, d, flag).select("response_id", "start", "end", F.col("segment").alias("quote"))
    return codebook.merge_evidence(side("A"), side("R"), side("N"))


# ---- names, ids, texts ----------------------------------------------------------------------------------------


@query(f"WITH {A}, n AS (SELECT DISTINCT code FROM a) SELECT code AS name, split_part(code, '-', 1) AS family, CASE WHEN instr(code, '-') > 0 THEN substr(code, instr(code, '-') + 1) ELSE '' END AS sub, 'code-' || substr(sha256(code), 1, 16) AS code_id FROM n")
def code_names(spark, d):
    n = _occ(spark, d).select("code").distinct()
    return n.select(F.col("code").alias("name"), names.family_of("code").alias("family"), names.sub_of("code").alias("sub"), names.code_id("code").alias("code_id"))


@query("SELECT event_id, 'asg-' || substr(sha256('run' || chr(31) || user_id || chr(31) || event_type || chr(31) || CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END), 1, 16) AS id FROM events")
def minted_ids(spark, d):
    return t.table(spark, d, "events").select("event_id", names.mint("asg", F.lit("run"), "user_id", "event_type", F.col("event_type") == "error").alias("id"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\\s') THEN 'whitespace,part_pattern' WHEN NOT regexp_full_match(lower(p_name), '[a-z0-9]+([_-][a-z0-9]+)*') THEN 'part_pattern' ELSE '' END AS reasons FROM part")
def name_grammar(spark, d):
    return t.table(spark, d, "part").select("p_partkey", F.array_join(names.grammar_reasons("p_name"), ",").alias("reasons"))


@query("SELECT doc_id, greatest(1, len(regexp_extract_all(text, '[.?!]+')))::INTEGER AS sentences, len(regexp_extract_all(text, '[^\\s]+'))::INTEGER AS words, CASE WHEN length(text) <= 120 THEN text ELSE substr(text, 1, 117) || '...' END AS excerpt FROM documents")
def text_measures(spark, d):
    return t.table(spark, d, "documents").select("doc_id", texts.sentence_count("text").alias("sentences"), texts.word_count("text").alias("words"), texts.excerpt("text").alias("excerpt"))


STOP = ", ".join(f"'{w}'" for w in sorted(texts.STOPWORDS))


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), k AS (SELECT doc_id, w FROM w WHERE w NOT IN ({STOP})),
s AS (SELECT doc_id, CASE WHEN length(w) <= 3 OR suffix(w, 'ss') THEN w WHEN suffix(w, 'sses') THEN CASE WHEN length(w) - 2 >= 3 THEN left(w, length(w) - 2) ELSE w END WHEN suffix(w, 'ies') THEN CASE WHEN length(w) - 2 >= 3 THEN left(w, length(w) - 3) || 'y' ELSE w END WHEN suffix(w, 'ing') THEN CASE WHEN length(w) - 3 >= 3 THEN left(w, length(w) - 3) ELSE w END WHEN suffix(w, 'ed') THEN CASE WHEN length(w) - 2 >= 3 THEN left(w, length(w) - 2) ELSE w END WHEN suffix(w, 's') THEN CASE WHEN length(w) - 1 >= 3 THEN left(w, length(w) - 1) ELSE w END ELSE w END AS term FROM k)
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM s GROUP BY term""")
def lexical_terms(spark, d):
    x = t.table(spark, d, "documents").select("doc_id", F.explode(texts.lexical_tokens("text")).alias("term"))
    return x.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("k")).groupBy("term").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query("WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS k FROM documents), f AS (SELECT k, min(doc_id) AS first FROM x GROUP BY k) SELECT doc_id AS response_id, CASE WHEN first < doc_id THEN first END AS duplicate_of FROM x JOIN f USING (k)")
def exact_duplicates(spark, d):
    return segments.duplicates(t.responses(spark, d))


@query("""WITH b AS (SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS x FROM benchmark), bs AS (SELECT DISTINCT substr(x, CAST(unnest(range(1, greatest(2, length(x) - 18))) AS BIGINT), 20) AS g FROM b WHERE x <> ''),
d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS x FROM documents), p AS (SELECT doc_id, x, unnest(range(1, greatest(2, length(x) - 18))) AS spot FROM d WHERE x <> '')
SELECT doc_id, CAST(min(spot) - 1 AS INTEGER) AS "at" FROM p WHERE substr(x, spot, 20) IN (SELECT g FROM bs) GROUP BY doc_id""")
def withheld_guard(spark, d):
    return withheld.first_hits(t.table(spark, d, "documents"), t.table(spark, d, "benchmark"), "doc_id")


@query("SELECT o_orderkey, round(CASE WHEN least(e1, e2) > greatest(s1, s2) THEN (least(e1, e2) - greatest(s1, s2)) / ((e1 - s1) + (e2 - s2) - (least(e1, e2) - greatest(s1, s2))) ELSE 0 END, 6) AS jaccard, least(e1, e2) > greatest(s1, s2) AS overlaps FROM (SELECT o_orderkey, o_custkey AS s1, o_custkey + length(o_orderpriority) * 20 AS e1, CAST(o_totalprice AS BIGINT) // 300 AS s2, CAST(o_totalprice AS BIGINT) // 300 + 150 AS e2 FROM (SELECT *, o_totalprice FROM orders))")
def interval_similarity(spark, d):
    x = t.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("s1"), (F.col("o_custkey") + F.length("o_orderpriority") * 20).alias("e1"), F.expr("cast(round(o_totalprice) as bigint) div 300").alias("s2"), F.expr("cast(round(o_totalprice) as bigint) div 300 + 150").alias("e2"))
    return x.select("o_orderkey", F.round(texts.interval_jaccard("s1", "e1", "s2", "e2"), 6).alias("jaccard"), texts.overlaps("s1", "e1", "s2", "e2").alias("overlaps"))


@query("WITH p AS (SELECT l_orderkey, list(DISTINCT p_type) AS x, list(DISTINCT l_returnflag) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT l_orderkey, round(len(list_intersect(x, ['SMALL', 'LARGE', 'PROMO'])) / (len(x) + 3 - len(list_intersect(x, ['SMALL', 'LARGE', 'PROMO']))), 6) AS jaccard FROM p")
def set_similarity(spark, d):
    x = t.table(spark, d, "lineitem").join(t.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_type").alias("x"))
    return x.select("l_orderkey", F.round(texts.jaccard("x", F.array(F.lit("SMALL"), F.lit("LARGE"), F.lit("PROMO"))), 6).alias("jaccard"))


@query("SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'other' END AS role FROM conversations")
def enum_values(spark, d):
    return t.table(spark, d, "conversations").select("conv_id", "turn", texts.one_of("role", ["user", "assistant"], "other").alias("role"))


@query("WITH x AS (SELECT event_id, event_id || '. ' || event_type AS cell FROM events) SELECT event_id, CAST(regexp_extract(cell, '^\\s*(\\d+)\\s*[.)]\\s*(.+)$', 1) AS BIGINT) AS number, regexp_extract(cell, '^\\s*(\\d+)\\s*[.)]\\s*(.+)$', 2) AS text FROM x")
def numbered_cells(spark, d):
    x = t.table(spark, d, "events").select("event_id", texts.numbered_cell(F.concat(F.col("event_id").cast("string"), F.lit(". "), "event_type")).alias("c"))
    return x.select("event_id", "c.number", "c.text")


@query("WITH x AS (SELECT l_orderkey AS number, l_orderkey * 10 + l_linenumber AS \"row\", min(l_returnflag) AS text FROM lineitem GROUP BY 1, 2) SELECT number + 1000 * (row_number() OVER (PARTITION BY number ORDER BY \"row\") - 1) AS response_id, \"row\", text FROM x")
def repeated_numbers(spark, d):
    from codeloom.sources.readers import assign_ids

    rows = t.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("number"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row")).agg(F.min("l_returnflag").alias("text"))
    return assign_ids(rows)


# ---- tagged labels --------------------------------------------------------------------------------------------

LABELS = "lb AS (SELECT label, count(*) FILTER (WHERE trim(content) <> '') AS cnt FROM (SELECT CASE WHEN p_size < 10 THEN p_name WHEN p_size < 20 THEN upper(p_name) WHEN p_size < 30 THEN replace(p_name, ' ', '-') WHEN p_size < 40 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '') END AS label, p_brand AS content FROM part) GROUP BY 1)"


def _labels(spark, d):
    n = F.col("p_name")
    label = F.when(F.col("p_size") < 10, n).when(F.col("p_size") < 20, F.upper(n)).when(F.col("p_size") < 30, F.replace(n, F.lit(" "), F.lit("-"))).when(F.col("p_size") < 40, F.replace(n, F.lit(" "), F.lit("_"))).otherwise(F.replace(n, F.lit(" "), F.lit("")))
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("row"), label.alias("tag"), F.col("p_brand").alias("content"))


@query(f"WITH {LABELS} SELECT label, cnt AS count FROM lb")
def label_counts(spark, d):
    return organise.label_counts(_labels(spark, d))


@query(f"""WITH {LABELS}, w AS (SELECT label, cnt, lower(regexp_replace(label, '\\s+', '', 'g')) AS k, first_value(label) OVER (PARTITION BY lower(regexp_replace(label, '\\s+', '', 'g')) ORDER BY regexp_matches(label, '\\s'), -cnt, length(regexp_replace(label, '[^A-Z]', '', 'g')), label) AS winner FROM lb),
st AS (SELECT DISTINCT winner AS name FROM w), alt AS (SELECT name, split_part(name, '-', 1) || '_' || substr(name, instr(name, '-') + 1) AS alternative FROM st WHERE instr(name, '-') > 0), mv AS (SELECT DISTINCT alt.name, alternative FROM alt JOIN st ON split_part(st.name, '-', 1) = split_part(alternative, '-', 1) AND st.name <> alt.name)
SELECT label, coalesce(alternative, winner) AS canonical, concat_ws('+', CASE WHEN label <> winner AND regexp_replace(label, '\\s+', '', 'g') <> regexp_replace(winner, '\\s+', '', 'g') THEN 'case' END, CASE WHEN label <> winner AND lower(label) <> lower(winner) THEN 'whitespace' END, CASE WHEN alternative IS NOT NULL THEN 'family_separator' END) AS rule FROM w LEFT JOIN mv ON winner = name""")
def label_consolidation(spark, d):
    return organise.consolidate(organise.label_counts(_labels(spark, d)))


@query(f"WITH {LABELS} SELECT split_part(label, '-', 1) AS family, label AS name, CASE WHEN instr(label, '-') > 0 THEN substr(label, instr(label, '-') + 1) ELSE '' END AS sub, cnt AS count, CAST(sum(cnt) OVER (PARTITION BY split_part(label, '-', 1)) AS BIGINT) AS family_count, row_number() OVER (PARTITION BY split_part(label, '-', 1) ORDER BY cnt DESC, label) AS place FROM lb")
def label_tree(spark, d):
    return organise.tree(organise.label_counts(_labels(spark, d)))


@query(f"WITH {LABELS}, x AS (SELECT label AS name, split_part(label, '-', 1) AS family, CASE WHEN instr(label, '-') > 0 THEN substr(label, instr(label, '-') + 1) ELSE '' END AS sub, cnt FROM lb), hs AS (SELECT DISTINCT family FROM x WHERE sub <> '') SELECT 'shared_subcode' AS category, sub AS subject FROM x WHERE sub <> '' GROUP BY sub HAVING count(DISTINCT family) > 1 UNION ALL SELECT 'single_segment_leaf', name FROM x WHERE sub <> '' AND cnt = 1 UNION ALL SELECT 'multi_hyphen_subcode', name FROM x WHERE instr(sub, '-') > 0 UNION ALL SELECT 'bare_top_level_code', name FROM x WHERE sub = '' AND family NOT IN (SELECT family FROM hs) UNION ALL SELECT 'family_with_own_segments', name FROM x WHERE sub = '' AND cnt > 0 AND family IN (SELECT family FROM hs)")
def structure_notes(spark, d):
    return organise.structure_notes(organise.label_counts(_labels(spark, d)))


@query(f"WITH {A}, n AS (SELECT DISTINCT code AS label FROM a UNION SELECT DISTINCT p_name FROM part) SELECT x.label AS label_a, y.label AS label_b, CAST(levenshtein(x.label, y.label) AS INTEGER) AS distance FROM n x JOIN n y ON x.label < y.label WHERE length(x.label) >= 5 AND length(y.label) >= 5 AND levenshtein(x.label, y.label) <= 2")
def label_near_misses(spark, d):
    return organise.near_misses(_occ(spark, d).select(F.col("code").alias("label")).union(t.table(spark, d, "part").select("p_name")))


SEGMENTS = "sm AS (SELECT p_partkey AS \"row\", p_brand AS code, p_name AS segment FROM part)"


def _segments(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("row"), F.col("p_brand").alias("code"), F.col("p_name").alias("segment"))


@query(f"WITH {SEGMENTS}, x AS (SELECT DISTINCT code, segment FROM sm), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY length(segment) DESC, segment) AS rank FROM x) SELECT code, segment, rank FROM r WHERE rank <= 2")
def code_examples(spark, d):
    return organise.examples(_segments(spark, d))


@query(f"WITH {SEGMENTS} SELECT segment, count(DISTINCT code) AS n_codes, count(DISTINCT code) > 2 AS over_limit FROM sm GROUP BY segment HAVING count(DISTINCT code) > 1")
def segments_under_several_codes(spark, d):
    return organise.shared_segments(_segments(spark, d))


@query(f"WITH {SEGMENTS}, k AS (SELECT code AS \"group\", unnest(string_split(replace(segment, ' ', '_'), '_')) AS token FROM sm), n AS (SELECT \"group\", token, count(*) AS n FROM k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY \"group\" ORDER BY n DESC, token) AS p FROM n) SELECT \"group\", string_agg(token, ' ' ORDER BY p) AS label FROM r WHERE p <= 3 GROUP BY 1")
def label_suggestions(spark, d):
    return organise.label_suggestion(_segments(spark, d).select(F.col("code").alias("group"), F.replace("segment", F.lit(" "), F.lit("_")).alias("name")))


@query(f"WITH {LABELS}, x AS (SELECT label AS name, split_part(label, '-', 1) AS family, instr(label, '-') > 0 AS has FROM lb) SELECT DISTINCT 'code-' || substr(sha256(family), 1, 16) AS code_id, family AS name, CAST(NULL AS VARCHAR) AS parent_id FROM x UNION ALL SELECT 'code-' || substr(sha256(name), 1, 16), name, 'code-' || substr(sha256(family), 1, 16) FROM x WHERE has")
def organised_codebook(spark, d):
    return organise.to_codebook(organise.tree(organise.label_counts(_labels(spark, d))))


@query(f"WITH {CODES}, def AS (SELECT lower(replace(p_brand, '#', '')) || '-' || lower(p_type) AS name, max(p_name) AS description FROM part GROUP BY 1) SELECT c.name, def.description FROM c LEFT JOIN def ON c.name = def.name")
def attached_definitions(spark, d):
    defs = t.table(spark, d, "part").groupBy(F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("-"), F.lower("p_type")).alias("name")).agg(F.max("p_name").alias("description"))
    return organise.attach_definitions(t.codebook(spark, d), defs)[0].select("name", "description")


# ---- checks ---------------------------------------------------------------------------------------------------


@query("WITH p AS (SELECT x.l_orderkey AS response_id, x.l_partkey AS pa, y.l_partkey AS pb, x.l_linenumber * 10 AS s1, x.l_linenumber * 10 + CAST(x.l_quantity AS INTEGER) AS e1, y.l_linenumber * 10 AS s2, y.l_linenumber * 10 + CAST(y.l_quantity AS INTEGER) AS e2 FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey), q AS (SELECT p.response_id, a.p_brand AS code_a, b.p_brand AS code_b FROM p JOIN part a ON pa = a.p_partkey JOIN part b ON pb = b.p_partkey WHERE a.p_brand < b.p_brand AND least(e1, e2) > greatest(s1, s2) AND (least(e1, e2) - greatest(s1, s2)) / ((e1 - s1) + (e2 - s2) - (least(e1, e2) - greatest(s1, s2))) >= 0.5) SELECT DISTINCT response_id, code_a, code_b FROM q")
def overlapping_codes(spark, d):
    x = t.table(spark, d, "lineitem").join(t.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    start = F.col("l_linenumber") * 10
    return checks.s4_pairs(x.select(F.col("l_orderkey").alias("response_id"), F.col("p_brand").alias("code"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end")))


@query()
def overlap_clusters(spark, d):
    """Union-find over the spans of each order; SQL has no such closure."""
    x = t.table(spark, d, "lineitem").join(t.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    start = F.col("l_linenumber") * 10
    return checks.s4_clusters(x.select(F.col("l_orderkey").alias("response_id"), F.col("p_brand").alias("code"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end")))


@query("WITH g AS (SELECT response_id, coder FROM (SELECT DISTINCT conv_id AS response_id FROM conversations), (SELECT unnest(['user', 'assistant']) AS coder)), n AS (SELECT conv_id AS response_id, role AS coder, count(DISTINCT text) AS k FROM conversations GROUP BY 1, 2) SELECT response_id, coder, coalesce(k, 0) AS n_codes FROM g LEFT JOIN n USING (response_id, coder) WHERE coalesce(k, 0) < 2 OR coalesce(k, 0) > 12")
def coder_counts(spark, d):
    x = t.table(spark, d, "conversations").select(F.col("conv_id").alias("response_id"), F.col("role").alias("coder"), F.col("text").alias("name"))
    return checks.s5_counts(x.where(F.col("coder").isin("user", "assistant")), x, ["user", "assistant"])


@query("SELECT conv_id, turn, greatest(1, len(regexp_extract_all(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[.?!]+')))::INTEGER AS sentences, len(regexp_extract_all(text, '[^\\s]+'))::INTEGER AS words FROM conversations WHERE greatest(1, len(regexp_extract_all(text, '[.?!]+'))) > 2 OR len(regexp_extract_all(text, '[^\\s]+')) > 40")
def long_quotes(spark, d):
    x = t.table(spark, d, "conversations").withColumnRenamed("text", "quote")
    measured = x.withColumn("sentences", texts.sentence_count(texts.squeeze("quote"))).withColumn("words", texts.word_count("quote"))
    return measured.where("sentences > 2 or words > 40").select("conv_id", "turn", "sentences", "words")


@query(f"WITH {CODES}, f AS (SELECT CASE WHEN parent_id IS NULL THEN 'top' ELSE 'sub' END AS check_id, CASE WHEN description = '' THEN 'WARN' ELSE 'INFO' END AS severity FROM c) SELECT check_id, severity, count(*) AS n FROM f GROUP BY 1, 2")
def findings_summary(spark, d):
    x = t.codebook(spark, d)
    return checks.summary(x.select(F.when(F.col("parent_id").isNull(), "top").otherwise("sub").alias("check_id"), F.when(F.col("description") == "", "WARN").otherwise("INFO").alias("severity")))


# ---- audit log ------------------------------------------------------------------------------------------------


@query(f"WITH {LOG} SELECT event, count(*) AS n FROM l GROUP BY event")
def audit_counts(spark, d):
    return eventlog.counts(t.audit(spark, d))


@query(f"""WITH {LOG}, x AS (SELECT run_id, event_id, event, subject, CASE WHEN event = 'checkpoint_evaluated' THEN k END AS b FROM l WHERE event IN ('response_prepared', 'checkpoint_evaluated')),
y AS (SELECT *, first_value(b IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt, max(b) OVER (PARTITION BY run_id) AS last FROM x) SELECT run_id, CAST(subject AS BIGINT) AS response_id, coalesce(nxt, last + 1, 1) AS batch FROM y WHERE event = 'response_prepared'""")
def next_boundary(spark, d):
    return eventlog.batch_of_response(t.audit(spark, d))


@query(f"WITH {LOG}, x AS (SELECT run_id, event, last_value(CASE WHEN event = 'response_prepared' THEN CAST(subject AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spot FROM l WHERE event IN ('response_prepared', 'judge_consulted')) SELECT run_id, spot AS response_id, count(*) AS n FROM x WHERE event = 'judge_consulted' AND spot IS NOT NULL GROUP BY 1, 2")
def last_response(spark, d):
    return eventlog.judge_calls(t.audit(spark, d))


@query(f"WITH {LOG} SELECT run_id, subject, max_by(k, event_id) AS value FROM l WHERE event = 'code_merged' GROUP BY 1, 2")
def last_event_wins(spark, d):
    return eventlog.last_per_subject(t.audit(spark, d), "code_merged", "response_id")


@query(f"WITH {LOG} SELECT run_id, k AS response_id, event, string_agg(subject, '|' ORDER BY event_id) AS codes FROM l WHERE event IN ('code_created', 'code_merged') GROUP BY 1, 2, 3")
def created_and_merged(spark, d):
    return eventlog.created_and_merged(t.audit(spark, d))


@query(f"WITH {LOG}, x AS (SELECT run_id, event_id, CAST(sum(CASE WHEN event = 'code_created' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS bracket, coalesce(sum(CASE WHEN event = 'checkpoint_evaluated' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM l WINDOW w AS (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT run_id, event_id, bracket, bracket > closed AS open FROM x")
def event_brackets(spark, d):
    return eventlog.brackets(t.audit(spark, d), "code_created", "checkpoint_evaluated").select("run_id", "event_id", "bracket", "open")


@query(f"WITH {LOG}, x AS (SELECT run_id, event_id, event, last_value(CASE WHEN event = 'code_created' THEN k END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started FROM l) SELECT run_id, event_id, started FROM x WHERE event = 'checkpoint_evaluated'")
def paired_markers(spark, d):
    x = eventlog.paired(t.audit(spark, d), "code_created", "checkpoint_evaluated")
    return x.select("run_id", "event_id", F.get_json_object("started_payload", "$.response_id").cast("bigint").alias("started"))


@query(f"WITH {LOG}, m AS (SELECT run_id, max(event_id) AS spot FROM l WHERE event = 'checkpoint_evaluated' GROUP BY 1) SELECT l.run_id, count(*) FILTER (WHERE spot IS NULL OR event_id > spot) AS n FROM l LEFT JOIN m ON l.run_id = m.run_id WHERE event = 'response_prepared' GROUP BY 1")
def since_last_checkpoint(spark, d):
    return eventlog.since_marker(t.audit(spark, d), "response_prepared", "checkpoint_evaluated")


@query("SELECT role AS task, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS input_tokens, CAST(sum(turn) AS BIGINT) AS output_tokens, round(sum((length(text) * 2.0 + turn * 8.0) / 1e6), 6) AS cost_usd FROM conversations GROUP BY role")
def call_costs(spark, d):
    x = t.table(spark, d, "conversations")
    return eventlog.call_totals(x.select(F.col("role").alias("task"), F.length("text").cast("bigint").alias("input_tokens"), F.col("turn").alias("output_tokens"), F.lit(2.0).alias("input_rate"), F.lit(8.0).alias("output_rate")))


# ---- similarity -----------------------------------------------------------------------------------------------


@query(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS code_id, {COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(code_id AS VARCHAR), code_id) AS rank FROM s) SELECT query_id, code_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8")
def top_k_codes(spark, d):
    """A search: its queries are the vectors whose id is divisible by 100, against all."""
    e = t.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    found = similarity.top_k(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e.select(F.col("vec_id").alias("code_id"), F.col("vec_id").cast("string").alias("name"), "vector"))
    return _rounded(found, "score")


@query(f"SELECT 'l' || a.label || '-v' || a.vec_id AS name_a, 'l' || b.label || '-v' || b.vec_id AS name_b, round({COSINE}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND ('l' || a.label || '-v' || a.vec_id) < ('l' || b.label || '-v' || b.vec_id) WHERE {COSINE} >= 0.4")
def near_duplicate_leaves(spark, d):
    e = t.table(spark, d, "embeddings").select(F.concat(F.lit("l"), F.col("label").cast("string"), F.lit("-v"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").alias("vector"))
    return _rounded(similarity.near_duplicate_leaves(e, 0.4), "score")


@query(f"WITH s AS (SELECT a.vec_id AS q, b.vec_id AS o, {COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, CAST(o AS VARCHAR)) AS k FROM s) SELECT CAST(q AS VARCHAR) AS name, CASE WHEN score > 0 THEN CAST(o AS VARCHAR) END AS nearest, round(greatest(0, score), 6) AS score FROM r WHERE k = 1")
def nearest_vocabulary(spark, d):
    """A search: its queries are the vectors whose id is divisible by 100, against all rows but the query's own."""
    e = t.table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("vector"))
    return _rounded(similarity.nearest(e.where("vec_id % 100 = 0"), e, itself=False), "score")


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def vector_norms(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return t.table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)), 5).alias("norm"))


@query()
def coder_agreement(spark, d):
    """Hungarian matching of the two roles' turns per conversation, in the lexical space."""
    v = t.table(spark, d, "conversations").where("role in ('user', 'assistant')").select(F.col("conv_id").alias("response_id"), "role", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    v = v.withColumn("vector", udfs.lexical_vector(spark)("text"))
    return similarity.match(v.where("role = 'user'"), v.where("role = 'assistant'"), "response_id", dissolve=False)


# ---- texts that need Python -----------------------------------------------------------------------------------


@query()
def text_segments(spark, d):
    return segments.segment_responses(t.responses(spark, d))


@query()
def quote_location(spark, d):
    """Benchmark items as quotes placed on documents that hold them or nearly do."""
    pairs = t.table(spark, d, "benchmark").select(F.col("item_id").alias("row"), F.lit("item").alias("tag"), F.col("text").alias("content"))
    return segments.place(pairs, t.responses(spark, d))


@query()
def lexical_embedding(spark, d):
    return providers.embed(t.table(spark, d, "documents").select("doc_id", "text"), "text")


@query()
def normalised_texts(spark, d):
    return t.table(spark, d, "documents").select("doc_id", udfs.normalise(spark)("text").alias("text"))


@query()
def ward_clusters(spark, d):
    return clustering.cluster_responses(occurrence.filtered(_occ(spark, d), 2))[0]


@query()
def agglomeration_schedule(spark, d):
    return _rounded(clustering.schedule_rows(clustering.ward(_occ(spark, d)).select("stage", "distance")), "distance", "delta")


@query()
def affinity_groups(spark, d):
    occ = occurrence.occurrence(t.baskets(spark, d))
    codes = occ.select(F.col("code").alias("name")).distinct().withColumn("description", F.lower(F.replace("name", F.lit("-"), F.lit(" "))))
    return clustering.affinity(codes, occ)


@query(f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), k AS (SELECT DISTINCT doc_id, term FROM w WHERE term NOT IN ({STOP}) AND length(term) >= 2) SELECT term, count(*) AS df FROM k GROUP BY term HAVING count(*) >= 2")
def document_frequencies(spark, d):
    found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), lambda x: (F.length(x) >= 2) & ~x.isin(*sorted(texts.STOPWORDS)))
    x = t.table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias("term"))
    return x.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 2")


@query(f"WITH {A} SELECT count(*) AS n, round(avg(s), 6) AS mean, count(*) FILTER (WHERE s >= 1) AS ge1, count(*) FILTER (WHERE s >= 3) AS ge3 FROM (SELECT o_custkey, count(code) AS s FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN a ON response_id = o_custkey AND split_part(code, '-', 1) = 'error' GROUP BY 1)")
def score_distribution(spark, d):
    people = t.table(spark, d, "orders").select(F.col("o_custkey").alias("response_id")).distinct().withColumn("text", F.lit(""))
    return lexical.score_distribution(lexical.scored_from_assignments(people, _occ(spark, d), "error"))


# ---- flows ----------------------------------------------------------------------------------------------------


@query(f"""WITH {LOG}, x AS (SELECT run_id, event_id, event, subject, CASE WHEN event = 'checkpoint_evaluated' THEN k END AS b FROM l WHERE event IN ('response_prepared', 'checkpoint_evaluated')),
y AS (SELECT *, first_value(b IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt, max(b) OVER (PARTITION BY run_id) AS last FROM x),
o AS (SELECT run_id, CAST(subject AS BIGINT) AS response_id, coalesce(nxt, last + 1, 1) AS batch FROM y WHERE event = 'response_prepared'), sz AS (SELECT run_id, batch, count(*) AS n_responses FROM o GROUP BY 1, 2),
nw AS (SELECT run_id, batch, count(DISTINCT l.subject) AS n FROM l JOIN o USING (run_id) WHERE l.event = 'code_created' AND l.k = o.response_id GROUP BY 1, 2),
j AS (SELECT run_id, event, last_value(CASE WHEN event = 'response_prepared' THEN CAST(subject AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spot FROM l WHERE event IN ('response_prepared', 'judge_consulted')),
jc AS (SELECT j.run_id, batch, count(*) AS n FROM j JOIN o ON j.run_id = o.run_id AND spot = response_id WHERE event = 'judge_consulted' GROUP BY 1, 2)
SELECT sz.run_id, sz.batch, n_responses, coalesce(nw.n, 0) AS n_new_codes, CAST(coalesce(jc.n, 0) AS BIGINT) AS n_judge_calls FROM sz LEFT JOIN nw ON nw.run_id = sz.run_id AND nw.batch = sz.batch LEFT JOIN jc ON jc.run_id = sz.run_id AND jc.batch = sz.batch""")
def timeline_batches(spark, d):
    return timeline.batch_summary(t.audit(spark, d))


@query(f"WITH {LOG}, m AS (SELECT run_id, subject, min(event_id) AS born_event, min_by(k, event_id) AS born_response FROM l WHERE event = 'code_created' GROUP BY 1, 2), g AS (SELECT run_id, subject, count(*) AS n, max(event_id) AS last FROM l WHERE event = 'code_merged' GROUP BY 1, 2) SELECT m.run_id, m.subject AS code, born_event, born_response, coalesce(n, 0) AS n_merged, last AS last_merge, 'alive' AS fate FROM m LEFT JOIN g ON m.run_id = g.run_id AND m.subject = g.subject")
def code_biographies(spark, d):
    return timeline.biographies(t.audit(spark, d)).drop("successor")


@query(f"WITH {A}, p AS (SELECT response_id, row_number() OVER (ORDER BY response_id) AS place FROM (SELECT DISTINCT response_id FROM a)) SELECT code, min(place) AS place, min(response_id) AS response_id FROM a JOIN p USING (response_id) GROUP BY code")
def first_appearances(spark, d):
    occ = _occ(spark, d)
    return timeline.first_appearance(occ, growth.place(occ))


@query()
def vocabulary_matching(spark, d):
    """Brands' leaves of the codebook against types and brands written the other way round."""
    book = t.codebook(spark, d).select("name", "description")
    other = t.table(spark, d, "part").select(F.lower(F.concat("p_type", F.lit("-"), F.replace("p_brand", F.lit("#"), F.lit("")))).alias("name")).distinct().withColumn("description", F.lit(""))
    return validation.match_codes(book, other)


@query()
def codebook_crosswalk(spark, d):
    book = t.codebook(spark, d).select("name", "description")
    return validation.crosswalk(codebook.leaves(t.codebook(spark, d)).select("name", "description"), book, names_only=True)["rollup"]


#: Words that stand for codes where the coding loop runs on invented prose.
KEYWORDS = {"article-the": ("the",), "article-la": ("la", "le"), "article-der": ("der", "die"), "link-and": ("and", "et", "y", "und"), "place-in": ("in", "en")}


@query()
def coding_loop(spark, d):
    """The whole fast loop over the documents: codes in the order they were admitted."""
    state, _ = loop.run(t.responses(spark, d).select("response_id", "content"), KEYWORDS, quotes=False)
    return spark.createDataFrame([(k, r, c) for k, (r, c) in enumerate(state.created)], "place int, response_id bigint, code string")


# ---- small operators over whole tables -------------------------------------------------------------------------


@query(f"WITH {CODES} SELECT code_id, name, description, parent_id FROM c")
def codebook_sorted(spark, d):
    return codebook.sorted_codes(t.codebook(spark, d))


@query(f"WITH {CODES} SELECT code_id, name, description, parent_id FROM c WHERE parent_id = 'p-brand11'")
def codebook_children(spark, d):
    return codebook.children_of(t.codebook(spark, d), "p-brand11")


@query(f"WITH {CODES} SELECT code_id, name, 'D1' AS check_id, 'WARN' AS severity, 'codebook' AS scope, name AS subject, 'no description' AS message, code_id AS data FROM c WHERE description = ''")
def findings_by_code(spark, d):
    codes = t.codebook(spark, d)
    bare = codes.where("description = ''")
    found = bare.select(F.lit("D1").alias("check_id"), F.lit("WARN").alias("severity"), F.lit("codebook").alias("scope"), F.col("name").alias("subject"), F.lit("no description").alias("message"), F.col("code_id").alias("data"))
    return checks.by_code(found, codes)


@query("SELECT doc_id AS response_id, substr(sha256(coalesce(text, '')), 1, 16) AS content_hash FROM documents")
def response_hashes(spark, d):
    return t.responses(spark, d).select("response_id", names.content_hash(F.coalesce("content", F.lit(""))).alias("content_hash"))


@query(f"WITH {CODES} SELECT name, 'code-' || substr(sha256(name), 1, 16) AS id FROM c")
def code_ids(spark, d):
    return t.codebook(spark, d).select("name", names.code_id("name").alias("id"))


@query("SELECT doc_id AS response_id, regexp_matches(source, '[A-Z]') AS upper, lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS key FROM documents")
def match_keys(spark, d):
    return t.responses(spark, d).select("response_id", F.col("source").rlike("[A-Z]").alias("upper"), udfs.match_key(spark)("source").alias("key"))


@query("SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name || ', ' || p_type), '[a-z0-9_]+'), '|') AS words FROM part")
def word_tokens(spark, d):
    words = udfs.lift(spark, "array<string>", kernels.word_tokens)
    return t.table(spark, d, "part").select("p_partkey", F.array_join(words(F.concat("p_name", F.lit(", "), "p_type")), "|").alias("words"))


@query("SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS longest FROM part")
def shared_word_runs(spark, d):
    """The longest run of words that a part's name shares with a text around it: the whole name."""
    run = udfs.longest_shared_run(spark)
    return t.table(spark, d, "part").select("p_partkey", run(F.col("p_name"), F.array(F.concat_ws(" ", "p_type", "p_name", "p_brand"))).alias("longest"))


@query("SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_brand || '-' || p_name || '_' || p_type), '[^-_]+'), '|') AS tokens FROM part")
def label_token_lists(spark, d):
    label = F.lower(F.concat("p_brand", F.lit("-"), "p_name", F.lit("_"), "p_type"))
    return t.table(spark, d, "part").select("p_partkey", F.array_join(texts.label_tokens(label), "|").alias("tokens"))


@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def metadata_keys(spark, d):
    return occurrence.metadata_keys(t.table(spark, d, "events").select(F.from_json("props", "map<string,string>").alias("meta")))


def _renames(spark, d) -> DataFrame:
    """Orders as applied operations that rename one code each, the orders of a customer being a run."""
    payload = F.concat(F.lit('{"renamed": {"c-'), F.col("o_orderkey").cast("string"), F.lit('": "n-'), F.col("o_orderkey").cast("string"), F.lit('"}}'))
    return t.table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("event_id"), F.lit("operation_applied").alias("event"), payload.alias("payload"))


@query("SELECT o_custkey AS run_id, 'c-' || o_orderkey AS old_id, 'n-' || o_orderkey AS new_id FROM orders")
def renamed_ids(spark, d):
    return eventlog.renamed_ids(_renames(spark, d))


@query("SELECT 'order ' || l_orderkey AS old_name, 'n-' || l_orderkey AS new_id FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey")
def code_lineage(spark, d):
    key = F.col("l_orderkey").cast("string")
    before = t.table(spark, d, "lineitem").select("l_orderkey").distinct().select(F.concat(F.lit("c-"), key).alias("code_id"), F.concat(F.lit("order "), key).alias("name"))
    return timeline.lineage(before, eventlog.renamed_ids(_renames(spark, d)))


@query(f"WITH {LOG}, x AS (SELECT run_id, event_id, event, k, last_value(CASE WHEN event = 'judge_consulted' THEN event_id END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT x.run_id, x.event_id AS decided_event, s AS started FROM x WHERE event = 'checkpoint_evaluated' AND s IS NOT NULL")
def checkpoint_markers(spark, d):
    """Purchases as decided checkpoints, each with the last error before it as its start."""
    e = t.audit(spark, d).withColumn("payload", F.when(F.col("event") == "judge_consulted", F.col("event_id").cast("string")).otherwise(F.col("payload")))
    named = e.withColumn("event", F.when(F.col("event") == "judge_consulted", "checkpoint_started").when(F.col("event") == "checkpoint_evaluated", "checkpoint_decided").otherwise(F.col("event")))
    return timeline.checkpoints(named).where("started_payload is not null").select("run_id", "decided_event", F.col("started_payload").cast("long").alias("started"))


@query("""SELECT event_id AS response_id, event_type AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def parsed_replies(spark, d):
    """Events as a model's fenced replies: one object each, its candidates read out."""
    k = F.get_json_object("props", "$.k")
    reply = F.concat(F.lit('```json\n{"codes": [{"name": " '), "event_type", F.lit(' ", "description": "'), k, F.lit('", "evidence": ["q"]}, {"evidence": []}, 5]}\n```'))
    read = udfs.lift(spark, "array<struct<name:string,description:string>>", lambda text, key: [{"name": c["name"], "description": c["description"]} for c in providers.parse_candidates(providers.parse_object(text), int(key))])
    rows = t.table(spark, d, "events").where(k.isNotNull()).select(F.col("event_id").alias("response_id"), F.explode(read(reply, F.col("event_id").cast("string"))).alias("c"))
    return rows.select("response_id", "c.name", F.col("c.description").cast("long").alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'merge' ELSE 'rename' END AS type, 'c-' || o_custkey AS target FROM orders WHERE o_orderstatus <> 'P'")
def parsed_operations(spark, d):
    """Orders as scripts of the slow loop; those of a type that does not exist are left out."""
    kind = F.when(F.col("o_orderstatus") == "F", "merge").when(F.col("o_orderstatus") == "O", "rename").otherwise("invent")
    reply = F.concat(F.lit('{"operations": [{"type": "'), kind, F.lit('", "targets": ["c-'), F.col("o_custkey").cast("string"), F.lit('"]}]}'))
    read = udfs.lift(spark, "array<struct<type:string,target:string>>", lambda text: [{"type": o["type"], "target": o["targets"][0]} for o in providers.parse_operations(providers.parse_object(text))])
    return t.table(spark, d, "orders").select("o_orderkey", F.explode(read(reply)).alias("o")).select("o_orderkey", "o.type", "o.target")


@query("""WITH x AS (SELECT conv_id AS response_id, role AS coder, turn AS ordinal, CASE WHEN turn % 3 = 0 THEN '' ELSE 'turn ' || turn END AS name, turn % 2 AS quoted FROM conversations)
SELECT response_id, coder, ordinal, name FROM x WHERE name <> '' AND quoted = 1""")
def candidates_in_shape(spark, d):
    """Turns as candidates: every third has no name, every second no evidence."""
    x = t.table(spark, d, "conversations").select(F.col("conv_id").alias("response_id"), F.col("role").alias("coder"), F.col("turn").alias("ordinal"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("name"), F.lit("d").alias("description"))
    proof = x.where("ordinal % 2 = 1").select(*checks.KEY, F.lit("q").alias("quote"))
    return checks.s1_schema(x, proof)[0].select(*checks.KEY, "name")


@query("""WITH n AS (SELECT user_id AS response_id, count(DISTINCT event_type) AS score FROM events GROUP BY 1) SELECT doc_id AS response_id, text, coalesce(score, 0) AS score FROM documents LEFT JOIN n ON doc_id = response_id""")
def scored_from_assignments(spark, d):
    occ = t.table(spark, d, "events").select(F.col("user_id").alias("response_id"), F.col("event_type").alias("code"))
    return lexical.scored_from_assignments(t.table(spark, d, "documents").select(F.col("doc_id").alias("response_id"), "text"), occ)


@query(f"WITH {B} SELECT x.code AS code_a, y.code AS code_b, z.code AS code_c, count(*) AS support FROM a x JOIN a y USING (response_id) JOIN a z USING (response_id) WHERE x.code < y.code AND y.code < z.code GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def basket_triples_all(spark, d):
    return occurrence.all_frequent_triples(occurrence.occurrence(t.baskets(spark, d)))

"""Checks over candidates: every check turns rows into findings and changes nothing.

candidates: (response_id, coder, ordinal, name, description); evidence: (response_id, coder, ordinal, quote). A candidate is
told by (response_id, coder, ordinal).
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.config import CodingRules
from codeloom.functions import kernels, udfs
from codeloom.functions.names import family_of, grammar_reasons, sub_of
from codeloom.functions.texts import interval_jaccard, sentence_count, squeeze, word_count
from codeloom.operators.codebook import _finding
from codeloom.runtime import ship

KEY = ["response_id", "coder", "ordinal"]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _subject() -> Column:
    return F.when(F.trim(F.coalesce("name", F.lit(""))) != "", F.col("name")).otherwise(F.concat(F.lit("candidate "), F.col("ordinal").cast("string")))


def s1_schema(candidates: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with a name and evidence, and the findings: no name or evidence is an error, no description or one that
    copies a quote a warning."""
    spark = candidates.sparkSession
    x = candidates.join(evidence.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_quotes")), KEY, "left").na.fill(0, ["n_quotes"])
    nameless, unproved = F.trim(F.coalesce("name", F.lit(""))) == "", F.col("n_quotes") == 0
    kept = x.where(~nameless & ~unproved)
    key = udfs.match_key(spark)
    described = kept.withColumn("d", key(F.coalesce("description", F.lit(""))))
    copies = described.where("d <> ''").join(evidence.withColumn("q", key(F.coalesce("quote", F.lit("")))), KEY).where("d = q").select(*KEY, "name").distinct()
    make = lambda rows, severity, text, marker: _finding(rows, "S1", severity, "candidate", _subject(), F.lit(text), marker=F.lit(marker), response_id=F.col("response_id"))
    return kept.select(*candidates.columns), union([
        make(x.where(nameless), "ERROR", "the candidate has no name", "missing_name"),
        make(x.where(unproved), "ERROR", "the candidate cites no evidence", "missing_evidence"),
        make(described.where("d = ''"), "WARN", "the candidate has no description", "missing_description"),
        make(copies, "WARN", "the description copies the candidate's quote", "description_copies_quote"),
    ])


def s1_markers(name: str | None, description: str | None, quotes: list[str]) -> list[str]:
    """The markers of the findings that s1_schema has for one candidate; it is kept if its name and evidence are not missing."""
    nameless, unproved = not (name or "").strip(" "), not quotes
    if nameless or unproved:
        return ["missing_name"] * nameless + ["missing_evidence"] * unproved
    key = kernels.match_key(description or "")
    if not key:
        return ["missing_description"]
    # a plain quote that begins otherwise needs no folding
    like = lambda q: not (q.isascii() and q.lstrip()[:1].lower() != key[:1]) and kernels.match_key(q) == key
    return ["description_copies_quote"] if any(like(q or "") for q in quotes) else []


def s2_locate(evidence: DataFrame, responses: DataFrame, rules: CodingRules = CodingRules()) -> DataFrame:
    """Evidence with where its quote stands in the normalised response: found, score, start, end. Exact hits stay in the
    JVM; only what is not found exactly goes through the window search."""
    spark = evidence.sparkSession
    norm = udfs.normalise(spark)
    texts = responses.select("response_id", norm(F.coalesce("content", F.lit(""))).alias("body"))
    x = evidence.join(texts, "response_id", "left").withColumn("needle", norm(F.coalesce("quote", F.lit("")))).withColumn("at", F.when(F.col("needle") != "", F.instr("body", F.col("needle"))).otherwise(0))
    keep = [c for c in evidence.columns]
    exact = x.where("at > 0").select(*keep, F.lit(True).alias("found"), F.lit(1.0).alias("score"), (F.col("at") - 1).cast("int").alias("start"), (F.col("at") - 1 + F.length("needle")).cast("int").alias("end"))
    rest = x.where("at = 0 or at is null").withColumn("w", udfs.locate(spark, rules.fuzzy_threshold)(F.coalesce("quote", F.lit("")), F.coalesce("body", F.lit(""))))
    return exact.unionByName(rest.select(*keep, "w.found", "w.score", "w.start", "w.end"))


def s2_findings(located: DataFrame) -> DataFrame:
    lost = _finding(located.where("not found"), "S2", "INFO", "evidence", F.col("quote"), F.lit("the quote is not in the response"), score=F.round("score", 6), response_id=F.col("response_id"))
    none = located.groupBy(*KEY).agg(F.max("found").alias("any")).where("not any")
    return union([lost, _finding(none, "S2", "ERROR", "candidate", F.concat(F.lit("candidate "), F.col("ordinal").cast("string")), F.lit("no quote of the candidate is in the response"), response_id=F.col("response_id"))])


def s2b_bounds(evidence: DataFrame, rules: CodingRules = CodingRules()) -> DataFrame:
    """Quotes with too many sentences or words."""
    q = evidence.withColumn("sentences", sentence_count(squeeze("quote"))).withColumn("words", word_count("quote"))
    long = q.where((F.col("sentences") > rules.max_quote_sentences) | (F.col("words") > rules.max_quote_words))
    return _finding(long, "S2b", "WARN", "evidence", F.col("quote"), F.lit("the quote is longer than a phrase or sentence"), sentences=F.col("sentences"), words=F.col("words"))


def s3_names(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Names that break the grammar, and bare names of a family that already has sub-names. existing: (name)."""
    odd = candidates.withColumn("reasons", grammar_reasons("name")).where(F.size("reasons") > 0)
    having = existing.where(sub_of("name") != "").select(F.lower(family_of("name")).alias("key")).distinct()
    bare = candidates.where(sub_of("name") == "").withColumn("key", F.lower("name")).join(having, "key", "left_semi")
    return union([
        _finding(odd, "S3", "WARN", "candidate", F.col("name"), F.lit("the name breaks the grammar"), marker=F.lit("name_grammar"), reasons=F.array_join("reasons", ",")),
        _finding(bare, "S3", "WARN", "candidate", F.col("name"), F.lit("the family exists and needs a sub-name"), marker=F.lit("bare_top_level"), reasons=F.lit("")),
    ])


def s4_clusters(spans: DataFrame, rules: CodingRules = CodingRules()) -> DataFrame:
    """(response_id, cluster, n_codes) of overlapping spans (response_id, code, start, end) with too many codes. Spans of one
    response that share at least the given part are linked, and a response's spans are one bounded group."""
    ship(spans.sparkSession)
    limit, least = rules.max_codes_per_segment, rules.segment_overlap
    kind = spans.schema["response_id"].dataType.simpleString()

    def clusters(rows: list[tuple]) -> list[tuple[int, int]]:
        """(least span, codes) of each cluster of one response's (start, end, code), in order."""
        parent = list(range(len(rows)))

        def root(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for i, (s1, e1, _) in enumerate(rows):
            for j in range(i + 1, len(rows)):
                s2, e2, _ = rows[j]
                if s2 >= e1:
                    break
                both = min(e1, e2) - max(s1, s2)
                if both >= least * ((e1 - s1) + (e2 - s2) - both):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
        codes: dict[int, set] = {}
        for k, (_, _, c) in enumerate(rows):
            codes.setdefault(root(k), set()).add(c)
        return [(c, len(x)) for c, x in codes.items() if len(x) > limit]

    def run(batches):
        """Batches come sorted by response; one that a batch's end cuts waits for its rest."""
        key, rows = None, []
        for b in batches:
            out = []
            for r, s, e, c in zip(b["response_id"].tolist(), b["start"].tolist(), b["end"].tolist(), b["code"].tolist()):
                if r != key:
                    out += [(key, *x) for x in clusters(rows)]
                    key, rows = r, []
                rows.append((s, e, c))
            yield pd.DataFrame(out, columns=["response_id", "cluster", "n_codes"])
        yield pd.DataFrame([(key, *x) for x in clusters(rows)], columns=["response_id", "cluster", "n_codes"])

    dealt = spans.select("response_id", "code", "start", "end").repartition("response_id").sortWithinPartitions("response_id", "start", "end", "code")
    return dealt.mapInPandas(run, f"response_id {kind}, cluster int, n_codes int")


def s4_pairs(spans: DataFrame, rules: CodingRules = CodingRules()) -> DataFrame:
    """Pairs of different codes on overlapping spans of one response, by an equi-join on the response."""
    a = spans.select("response_id", F.col("code").alias("code_a"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = spans.select("response_id", F.col("code").alias("code_b"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    return a.join(b, "response_id").where("code_a < code_b").where(interval_jaccard("s1", "e1", "s2", "e2") >= rules.segment_overlap).select("response_id", "code_a", "code_b").distinct()


def s5_counts(candidates: DataFrame, responses: DataFrame, coders: list[str], rules: CodingRules = CodingRules()) -> DataFrame:
    """(response_id, coder, n_codes) outside the bounds; a coder without candidates counts 0."""
    spark = candidates.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in coders])).alias("coder"))
    n = candidates.groupBy("response_id", "coder").agg(F.countDistinct("name").alias("n_codes"))
    grid = responses.select("response_id").distinct().join(F.broadcast(names), F.lit(True))
    x = grid.join(n, ["response_id", "coder"], "left").na.fill(0, ["n_codes"])
    return x.where((F.col("n_codes") < rules.min_codes_per_response) | (F.col("n_codes") > rules.max_codes_per_response))


def m3_fit(evidence: DataFrame, tau_fit: float = 0.3) -> DataFrame:
    """Evidence (code_vector, quote_vector) with its fit and whether it goes to a judge."""
    from codeloom.functions.texts import cosine

    x = evidence.withColumn("fit", cosine("code_vector", "quote_vector"))
    return x.withColumn("escalates", F.round("fit", 6) < tau_fit)


def describe_guards(descriptions: DataFrame, most_sentences: int = 3, most_run: int = 8) -> DataFrame:
    """D1 empty, D2 too many sentences, D3 copies a segment, D4 shares a long run of words. descriptions: (code, description,
    segments array)."""
    spark = descriptions.sparkSession
    norm, key, run = udfs.normalise(spark), udfs.match_key(spark), udfs.longest_shared_run(spark)
    x = descriptions.withColumn("text", norm(F.coalesce("description", F.lit("")))).withColumn("segments", F.coalesce("segments", F.array().cast("array<string>")))
    full = x.where("text <> ''").withColumn("run", run("text", "segments")).withColumn("key", key("text"))
    copied = full.select("code", "key", F.explode("segments").alias("s")).where(key("s") == F.col("key")).select("code").distinct()
    make = lambda rows, check, severity, text, **data: _finding(rows, check, severity, "codebook", F.col("code"), F.lit(text), **(data or {"code": F.col("code")}))
    return union([
        make(x.where("text = ''"), "D1", "ERROR", "there is no description"),
        make(full.where(sentence_count("text") > most_sentences), "D2", "WARN", "the description is too long", sentences=sentence_count("text")),
        make(copied, "D3", "ERROR", "the description copies a segment"),
        make(full.where(F.col("run") >= most_run), "D4", "ERROR", "the description shares a long run of words with a segment", run=F.col("run")),
    ])


def summary(findings: DataFrame) -> DataFrame:
    """Findings per check and severity."""
    return findings.groupBy("check_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def by_code(findings: DataFrame, codes: DataFrame) -> DataFrame:
    return codes.select("code_id", "name").join(findings, F.col("name") == F.col("subject"))

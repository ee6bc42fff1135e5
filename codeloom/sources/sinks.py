"""Exports: canonical JSON, dense CSV, figures and reports. What is rendered is an aggregate of bounded size."""

from __future__ import annotations

import hashlib
import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.occurrence import dense

#: Rows and codes that an interchange file or a figure takes; working data stays in Parquet.
MOST_ROWS, MOST_CODES = 100_000, 2000


def _bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write Parquet instead")
    return rows


def corpus_json(responses: DataFrame) -> str:
    """Canonical corpus JSON, by source and id."""
    rows = _bounded(responses.orderBy("source", "response_id"), MOST_ROWS)
    made = [{"id": r["response_id"], "question": r["question"], "content": r["content"], "source": r["source"], "meta": r["meta"] or {}} for r in rows]
    return json.dumps({"responses": made}, sort_keys=True, ensure_ascii=False, indent=2)


def corpus_hash(responses: DataFrame) -> str:
    return hashlib.sha256(corpus_json(responses).encode()).hexdigest()[:16]


def write_text(spark, path: str, text: str) -> None:
    """One file through Spark's file system, so that any storage works."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs_path, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_corpus_json(responses: DataFrame, path: str) -> None:
    write_text(responses.sparkSession, path, corpus_json(responses))


def write_matrix_csv(occ: DataFrame, path: str) -> None:
    """The dense matrix, rows by id and columns by name; partitions stay apart, the header is in each."""
    codes = [r["code"] for r in _bounded(occ.select("code").distinct().orderBy("code"), MOST_CODES)]
    dense(occ, codes).repartitionByRange("response_id").sortWithinPartitions("response_id").write.mode("overwrite").csv(path, header=True)


def codebook_json(codes: DataFrame, evidence: DataFrame | None = None) -> str:
    """Canonical codebook JSON: codes by name, keys in order, no time stamps."""
    proof: dict[str, list] = {}
    if evidence is not None:
        for r in _bounded(evidence.orderBy("code_id", "response_id", "quote"), MOST_ROWS):
            proof.setdefault(r["code_id"], []).append({"response_id": r["response_id"], "quote": r["quote"], "verified": r["verified"]})
    made = [{"id": r["code_id"], "name": r["name"], "description": r["description"], "parent_id": r["parent_id"], "evidence": proof.get(r["code_id"], [])} for r in _bounded(codes.orderBy("name", "code_id"), MOST_ROWS)]
    return json.dumps({"codes": made}, sort_keys=True, ensure_ascii=False, indent=2)


def snapshot_id(text: str) -> str:
    return "snap-" + hashlib.sha256(text.encode()).hexdigest()[:16]


def mermaid(codes: DataFrame, counts: dict[str, int] | None = None) -> str:
    rows = _bounded(codes.select("code_id", "name", "parent_id").orderBy("name"), MOST_CODES)
    mark = {r["code_id"]: f"c{k}" for k, r in enumerate(rows)}
    label = lambda n: n.replace('"', "'") + (f" ({counts[n]})" if counts and n in counts else "")
    lines = ["flowchart LR", *(f'  {mark[r["code_id"]]}["{label(r["name"])}"]' for r in rows)]
    return "\n".join([*lines, *(f"  {mark[r['parent_id']]} --> {mark[r['code_id']]}" for r in rows if r["parent_id"] in mark)])


def _svg(width: int, height: int, title: str, body: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}"><title>{html.escape(title)}</title>{"".join(body)}</svg>'


def curve_svg(points: list[tuple[float, float]], title: str, width: int = 760, height: int = 380) -> str:
    """A line over batches: saturation, growth or a timeline of codes."""
    if not points:
        return _svg(width, height, title, [])
    top, last = max(y for _, y in points) or 1, max(x for x, _ in points) or 1
    at = [(40 + (width - 60) * x / last, height - 30 - (height - 60) * y / top) for x, y in points]
    line = " ".join(f"{x:.1f},{y:.1f}" for x, y in at)
    return _svg(width, height, title, [f'<polyline fill="none" stroke="black" points="{line}"/>', *(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3"/>' for x, y in at)])


def dendrogram_svg(merges: list[tuple[int, int, float, int]], n: int, title: str, width: int = 960, height: int = 520) -> str:
    """An agglomeration (left, right, distance, size) over n leaves."""
    children = {n + k: (int(a), int(b)) for k, (a, b, *_rest) in enumerate(merges)}
    order, todo = [], [n + len(merges) - 1] if merges else list(range(n))
    while todo:
        x = todo.pop()
        if x in children:
            todo += children[x][::-1]
        else:
            order.append(x)
    top = max((m[2] for m in merges), default=1) or 1
    spot = {x: (20 + (width - 40) * k / max(1, n - 1), height - 20.0) for k, x in enumerate(order)}
    body = []
    for k, (a, b, d, _) in enumerate(merges):
        (xa, ya), (xb, yb) = spot[int(a)], spot[int(b)]
        y = height - 20 - (height - 40) * d / top
        body.append(f'<path fill="none" stroke="black" d="M{xa:.1f},{ya:.1f}V{y:.1f}H{xb:.1f}V{yb:.1f}"/>')
        spot[n + k] = ((xa + xb) / 2, y)
    return _svg(width, height, title, body)


def run_report(stats: dict) -> str:
    """A plain-text report of a run's figures."""
    return "\n".join(["Run report", "", *(f"{k}: {v}" for k, v in sorted(stats.items()))]) + "\n"


def codebook_html(codes: list[dict], title: str = "Codebook") -> str:
    """The explorer; it holds respondents' quotes and is not for sharing."""
    part = lambda c: f"<section><h2>{html.escape(c['name'])}</h2><p>{html.escape(c.get('description') or '')}</p><ul>{''.join(f'<li>{html.escape(q)}</li>' for q in c.get('quotes', []))}</ul></section>"
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title>{''.join(map(part, codes))}"


def views_html(tables: dict[str, list[dict]], title: str = "Views") -> str:
    """The page that may be shared: names and counts only, no respondent's text."""
    def view(name: str, rows: list[dict]) -> str:
        names = list(rows[0]) if rows else []
        head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[n]))}</td>" for n in names) + "</tr>" for r in rows)
        return f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>"

    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title>" + "".join(view(k, v) for k, v in tables.items())


def usage_summary(usage: DataFrame) -> str:
    return "\n".join(f"{r['name']}: {r['n_responses']}" for r in _bounded(usage.orderBy(F.desc("n_responses"), "name"), MOST_CODES))


def decision_matrix_markdown(rows: list[dict]) -> str:
    names = list(rows[0]) if rows else []
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(str(r[n]).replace("|", "\\|") for n in names) + " |" for r in rows)])

"""The verdict's one pass over requests, plan and spans against the rules one by one."""

from pyspark.sql import functions as F

from tailwatch.operators import quality as Q
from tailwatch.plans import load
from tailwatch.plans import tables as V

SF = "/root/testdata/sf0.001"
NAMES = Q.SPAN_NAMES
RUN = (0, "C", 1, "r")
KEYS = "campaign_id long, condition_id string, repetition int, run_id string"


def span(rid, i, run=RUN, copies=0, **other):
    ids = {"trace_id": f"{rid or 'q'}".encode().hex().rjust(32, "0"), "span_id": f"{i}".rjust(16, "a"), "parent_span_id": "0".rjust(16, "a") if i else None,
           "attributes": f'{{"request_id":"{rid}"}}' if rid else "{broken"} | other
    return (*run, NAMES[i], ids["trace_id"], ids["span_id"], ids["parent_span_id"], ids["attributes"], copies)


def test_ledger_counts_what_the_rules_find(spark):
    other = (1, "D", 2, "s")
    requests = [(*RUN, rid, status, copies) for rid, status, copies in (
        ("whole", "success", 1), ("twice", "success", 1), ("twice", "success", 1), ("unplanned", "success", 0), ("failed", "failed", 1), ("copied", "success", 2),
        ("bare", "success", 1), ("orphan", "success", 1), (None, "success", 1))] + [(*other, "whole", "success", 1)]
    spans = [span(rid, i) for rid in ("whole", "twice", "unplanned") for i in range(3)] + [span("whole", i, other) for i in range(3)]
    spans += [span("orphan", 0), span("orphan", 1, parent_span_id="f" * 16), span("orphan", 2, trace_id="short")]
    spans += [span("copied", 0, copies=1), span("copied", 1), span("copied", 2), span(None, 0), span(None, 1, span_id="Z" * 16), span("nowhere", 0, copies=1)]
    req = spark.createDataFrame(requests, f"{KEYS}, request_id string, status string, copies int")
    sp = spark.createDataFrame(spans, f"{KEYS}, span_name string, trace_id string, span_id string, parent_span_id string, attributes string, copies int")
    plan = req.withColumn("_", F.explode(F.expr("array_repeat(1, copies)"))).select(*Q.RUN, "request_id")
    keyed = sp.withColumn("_", F.explode(F.expr("array_repeat(1, copies + 1)"))).withColumn(
        "span_key", F.concat("span_name", F.lit("|"), F.get_json_object("attributes", "$.request_id"))).where("span_key is not null")
    single = {
        "dq_duplicates": Q.duplicates(plan, Q.RUN, "request_id", "x"), "dq_unplanned": Q.unplanned(req, plan), "dq_accounting": Q.accounting(req, plan).where("accounting_ok = 0"),
        "dq_spans": Q.span_format_issues(sp), "dq_foreign_spans": Q.foreign_spans(sp, plan), "dq_span_duplicates": Q.duplicates(keyed, ["run_id"], "span_key", "x"), "dq_span_trees": Q.span_trees(req, sp)}
    want = {(r.run_id, name): r["count"] for name, rows in single.items() for r in rows.groupBy("run_id").count().collect()}
    got = {(r.run_id, name): r[name] for r in Q.ledger_counts(req, sp).collect() for name in single if r[name]}
    assert got == want and {name for _, name in want} >= set(single) - {"dq_accounting"}


def test_verdict_reads_the_events_a_few_times(spark):
    V.release()
    plan = load()["dq_verdict"].build(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # requests, ledger (requests and spans) and traces; the bounds are a table of their own
    assert 0 < plan.count("props#") and sum("Relation" in line and "props#" in line for line in plan.splitlines()) <= 4
    V.release()

"""Plan profile of a DataFrame: what the physical plan shuffles, joins,
aggregates and pushes to the scans (read from ``explain`` output)."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def explain_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def plan_summary(df: DataFrame) -> dict:
    simple = explain_text(df, "simple")
    formatted = explain_text(df, "formatted")
    exchanges = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)",
                           simple)
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin) \[[^\]]*\], \[[^\]]*\], (\w+)",
                       simple)
    joins += [(j, "") for j in re.findall(r"(BroadcastNestedLoopJoin|CartesianProduct)", simple)]
    pushed = sorted({f for p in re.findall(r"PushedFilters: \[([^\]]+)\]", formatted)
                     for f in re.split(r", (?=[A-Z])", p) if f and not f.startswith("IsNotNull")})
    return {
        "shuffles": {k: exchanges.count(k) for k in sorted(set(exchanges))},
        "broadcasts": simple.count("BroadcastExchange"),
        "joins": [f"{j} {t}".strip() for j, t in joins],
        "partial_aggregates": len(re.findall(r"partial_", simple)) > 0,
        "aggregates": sorted(set(re.findall(r"(HashAggregate|SortAggregate|ObjectHashAggregate)", simple))),
        "windows": simple.count("Window ["),
        "python": any(k in simple for k in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF")),
        "pushed_filters": pushed,
        "codegen_stages": len(re.findall(r"\*\(\d+\)", simple)),
    }

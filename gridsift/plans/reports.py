"""Markdown reports from small result tables (a row for each cluster, recommendation or feature set)."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame


def recommendation_report(recommendations: DataFrame) -> str:
    rows = recommendations.orderBy("cluster", "rank").collect()
    lines = ["# Recommendations", "", "Each one names the measured trait of the cluster that triggers it.", ""]
    for (cluster, label), own in groupby(rows, key=lambda r: (r["cluster"], r["cluster_name"])):
        lines += [f"## {label} (cluster {cluster})", ""]
        for r in own:
            lines += [f"{r['rank']}. **{r['recommendation']}** [{r['priority'].upper()}, {r['category']}]: {r['evidence']}"]
        lines.append("")
    return "\n".join(lines)


def ablation_report(table: DataFrame) -> str:
    rows = table.collect()
    columns = table.columns
    lines = ["# Feature sets compared", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    if rows:
        best = lambda c: max(rows, key=lambda r: r[c] if r[c] is not None else float("-inf"))["feature_set"]
        lines += ["", f"- Best silhouette: {best('silhouette')}", f"- Most stable: {best('mean_ari')}", f"- Best balance: {best('balance')}"]
        lines += ["- Recommended: behavioral, which describes how consumers use energy rather than how much."]
    return "\n".join([*lines, ""])


def validation_report(overview: DataFrame, statistics: DataFrame, consumers: DataFrame) -> str:
    whole = overview.first()
    lines = ["# Panel check", "", f"- Consumers: {whole['consumers']}", f"- Rows: {whole['rows']}", f"- Times: {whole['first_time']} to {whole['last_time']}", "", "## Archetypes", ""]
    counts = {r["archetype"]: r["consumers"] for r in consumers.collect()}
    for r in statistics.orderBy("archetype").collect():
        lines.append(f"- {r['archetype']}: {counts.get(r['archetype'], 0)} consumers, mean {r['avg_mean']:.4f} kWh, variation {r['avg_cv'] or 0:.3f}")
    return "\n".join([*lines, ""])


def summary_report(summary: dict, profiles: DataFrame) -> str:
    lines = ["# Summary", "", *(f"- {k}: {v}" for k, v in summary.items()), "", "## Clusters", ""]
    for r in profiles.orderBy("cluster").collect():
        own = r.asDict()
        lines.append(f"- {own['cluster_name']} (cluster {own['cluster']}): {own['size']} consumers ({own['size_percentage']:.1f} %)")
    return "\n".join([*lines, ""])

"""The last of the catalogue: whole reports, from queries that are registered before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from palimpsest import queries_flow, queries_glue  # noqa: F401  their sections
from palimpsest.plans import report
from palimpsest.queries import ORACLE_SQL, QUERIES, _found, query

_c = F.col

#: Sections of a week's report, and the query that each is.
_SECTIONS = {
    "top_patterns": "top_patterns", "pattern_frequency": "pattern_frequency_week", "emerging": "emerging_patterns", "delta": "period_delta", "growth": "growth_candidate", "struggle": "struggle_candidate",
    "dynamics": "relational_dynamics", "arcs": "relationship_arcs", "high_signal": "high_signal", "environment": "environment_observations", "motifs": "unprocessed_motifs", "lessons": "repeated_lessons",
    "beliefs": "belief_changes", "open_loops": "unresolved_open_loops", "contradictions": "active_contradictions", "aging": "pattern_aging", "archetypes": "archetype_shift", "shadow": "shadow_scan",
    "proofs": "proof_chains", "eras": "era_vocabulary", "environments": "environments", "windows": "catchup_windows", "facts": "episode_facts",
    "disappearing": "disappearing_people", "ignored": "ignored_lessons", "gaps": "biographical_gaps",
}


@query(" UNION ALL ".join(f"SELECT '{section}' AS section, (SELECT count(*) FROM ({ORACLE_SQL[name]})) AS n" for section, name in _SECTIONS.items()), base=False)
def full_report(spark, d):
    """Every section of a week's report, with its rows as JSON lines under the section's name, counted."""
    return report.section_sizes({section: QUERIES[name](spark, d) for section, name in _SECTIONS.items()})


#: The columns of each section, in the order in which they are told; those that end with * are fractions.
_TOLD = {
    "top_patterns": "pattern_id episodes share*", "pattern_frequency": "pattern_id episodes share* first_day last_day", "emerging": "pattern_id first_episode", "delta": "pattern_id now was delta", "growth": "pattern_id now was drop", "struggle": "pattern_id episodes negative_findings",
    "dynamics": "person findings excerpts", "arcs": "person episodes top_kinds", "high_signal": "node_id episode_id signal_strength", "environment": "node_id person episode_id", "motifs": "pattern_id links", "lessons": "lesson_id episodes", "beliefs": "target_node_id new_node_id old_statement new_statement",
    "open_loops": "loop_id days_open", "contradictions": "node_id statement_a statement_b days_open", "aging": "customer quiet_days band weight* ask", "archetypes": "pattern_id trend now was detected", "shadow": "detected decisions targets branches contradictions", "proofs": "pattern_id instances first_day last_day samples",
    "eras": "key spelling total", "environments": "person findings weighty confident", "windows": "report_type period_start period_end", "facts": "episode_id event_date findings first_finding", "disappearing": "person previous_episodes previous_share*", "ignored": "lesson_id days", "gaps": "node_id episode_id event_date",
}


def _told_sql(section: str) -> str:
    one = lambda c: f"CAST(CAST(round({c[:-1]} * 1000) AS BIGINT) AS VARCHAR)" if c.endswith("*") else f'CAST("{c}" AS VARCHAR)'
    return f"SELECT '{section}' AS section, concat_ws('; ', {', '.join(map(one, _TOLD[section].split()))}) AS line FROM ({ORACLE_SQL[_SECTIONS[section]]})"


@query(" UNION ALL ".join(map(_told_sql, _TOLD)), base=False)
def report_contents(spark, d):
    """Every section of a week's report, row by row, as lines."""
    one = lambda c: F.round(_c(c[:-1]) * 1000).cast("long").cast("string") if c.endswith("*") else _c(c).cast("string")
    parts = [QUERIES[_SECTIONS[section]](spark, d).select(F.lit(section).alias("section"), F.concat_ws("; ", *map(one, columns.split())).alias("line")) for section, columns in _TOLD.items()]
    return reduce(lambda a, b: a.union(b), parts)


_QUARTER = [("event_date >= DATE '2024-01-08' AND event_date < DATE '2024-01-15'", "event_date >= DATE '2024-01-16' AND event_date < DATE '2024-02-01'"), ("event_date >= DATE '2024-01-01' AND event_date < DATE '2024-01-08'", "event_date >= DATE '2023-10-18' AND event_date < DATE '2024-01-16'")]


@query(reduce(lambda sql, change: sql.replace(*change), _QUARTER, ORACLE_SQL["archetype_shift"]), base=False)
def archetype_quarter(spark, d):
    """How patterns moved, and were noticed, against the ninety days before."""
    found = _found(spark, d)
    return report.archetype_shift(report.in_window(found, "2024-01-16", "2024-02-01"), report.in_window(found, "2023-10-18", "2024-01-16"), "click")

"""All results of one refresh of the analyst's view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fixed
from palisade.operators import profile, report, rollup, score


def attackers_in(population: DataFrame) -> DataFrame:
    """Distinct sources of the hack alerts in the population."""
    return (
        population.filter(F.col("llm_classification") == "hack")
        .select("src_ip").distinct()
    )


def current_profiles(
    alerts: DataFrame,
    population: DataFrame,
    population_limit: int | None = fixed.NEWEST_ROWS,
    rollups: DataFrame | None = None,
) -> DataFrame:
    """Profiles, over the whole table, of the attackers in the population.

    With all alerts as the population every attacker qualifies and no join is
    needed; how to join is the optimizer's choice otherwise. With ``rollups``
    the alerts themselves are not read.
    """
    sources = None if population_limit is None else attackers_in(population)
    if rollups is not None:
        return rollup.attacker_profile(rollups, sources)
    return profile.attacker_profile(alerts, sources)


def attacker_cards(
    alerts: DataFrame,
    profiles: DataFrame,
    assessor: score.BatchFunction | None = None,
    rollups: DataFrame | None = None,
) -> DataFrame:
    """Display texts of the profiles, the sources' operating systems, assessments."""
    sources = profiles.select("src_ip")
    if rollups is not None:
        systems = rollup.attacker_os(rollups, sources)
    else:
        systems = profile.attacker_os(alerts.join(sources, "src_ip", "left_semi"))
    assessed = score.assess_cards(profiles, assessor).select(
        "src_ip", "methodology", "objective", "skill_level", "response",
        "assessed_threat_level", "assessed",
    )
    cards = profile.profile_card(profiles).drop("objective", "skill_level", "response")
    return cards.join(systems, "src_ip", "left").join(assessed, "src_ip", "left")


class AnalystView(dict):
    """Tables of one refresh by name, all lazy, over one cached population.

    Use it as a context manager, or call :meth:`close` when the refresh is
    over: only then is the population released. Opening the next refresh never
    reuses it, so rows that other writers added in the meantime are seen.
    """

    def __init__(self, population: DataFrame, tables: dict[str, DataFrame]) -> None:
        super().__init__(tables)
        self._population = population

    def close(self) -> None:
        self._population.unpersist()

    def __enter__(self) -> AnalystView:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def analyst_view(
    alerts: DataFrame,
    *,
    population_limit: int | None = fixed.NEWEST_ROWS,
    assessor: score.BatchFunction | None = None,
    rollups: DataFrame | None = None,
    newest: DataFrame | None = None,
    **filters,
) -> AnalystView:
    """Every table of the view by name.

    Read ``alerts`` anew for each refresh. Figures and reports cover the newest
    alerts and ignore the filters; only the feed is filtered. A limited
    population is found through the age of its oldest row and cached, so the
    table is searched once per refresh. ``assessor`` answers for attackers in
    place of the rules (see :func:`palisade.operators.score.assess_cards`).
    ``rollups`` are those of ``alerts`` and stand in for them in the profiles;
    ``newest`` are its newest rows, if the caller knows a shorter way to them.
    """
    if population_limit is None:
        population = alerts
    else:
        population = newest if newest is not None else report.newest_stored_alerts(
            alerts, population_limit
        )
        # an equal plan of an earlier refresh would bring its rows back
        population = population.unpersist(blocking=True).cache()
    accuracy = report.accuracy_report(population)
    profiles = current_profiles(alerts, population, population_limit, rollups)
    feed = report.filter_alerts(population, **filters)
    return AnalystView(population, {
        "kpis": report.kpis(population),
        "verdict_counts": report.verdict_counts(population),
        "attack_type_counts": report.attack_type_counts(population),
        "risk_timeline": report.risk_timeline(population),
        "attackers": attacker_cards(alerts, profiles, assessor, rollups),
        "fp_suppression": report.fp_suppression(population),
        "feed_count": report.feed_count(feed),
        "alert_feed": report.alert_feed(feed),
        "accuracy_report": accuracy,
        "accuracy_overall": report.accuracy_overall(accuracy),
    })

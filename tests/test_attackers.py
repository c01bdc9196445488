from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from data import alerts_frame, shuffled
from palisade.operators import enrich, profile, score
from palisade.operators.numbering import with_position
from palisade.plans.analytics import analyst_view, current_profiles
from palisade.operators.report import newest_alerts


def test_positions_cut_through_a_hot_group(spark):
    frame = shuffled(spark.range(9000).select(
        F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("g"),
        (F.col("id") % 5).alias("t"), "id"))
    got = with_position(frame, ["t", "id"], within=["g"], total="size")
    assert got.columns == ["g", "t", "id", "position", "size"]
    expected = {}
    for g, t, i in sorted((r["g"], r["t"], r["id"]) for r in frame.collect()):
        expected.setdefault(g, []).append(i)
    for row in got.collect():
        assert expected[row["g"]][row["position"] - 1] == row["id"]
        assert row["size"] == len(expected[row["g"]])


def test_positions_over_everything_and_null_groups(spark):
    frame = shuffled(spark.range(1000))
    got = {r["id"]: r["position"] for r in with_position(frame, ["id"]).collect()}
    assert got == {n: n + 1 for n in range(1000)}
    nulls = spark.range(10).select(F.lit(None).cast("string").alias("g"), "id")
    numbered = with_position(nulls, ["id"], within=["g"])
    assert sorted(r["position"] for r in numbered.collect()) == list(range(1, 11))


def test_positions_of_nothing(spark):
    assert with_position(spark.range(0), ["id"]).count() == 0


ATTACKERS = [
    {"src_ip": "a", "attack_type": "dos", "dst_port": 80, "risk_score": 9},
    {"src_ip": "a", "attack_type": None, "dst_port": 0, "risk_score": None},
    {"src_ip": "a", "attack_type": "", "dst_port": 22},
    {"src_ip": "a", "llm_classification": "normal", "dst_port": 443, "risk_score": 10},
    {"src_ip": "b"},
    {"src_ip": "b", "llm_classification": "normal"},
    {"src_ip": "c", "dst_port": None, "attack_type": "exploit"},
    {"src_ip": "c", "dst_port": 0, "attack_type": "port_scan"},
    {"src_ip": "d", "llm_classification": None},
]


def test_repeat_attackers(spark, rows):
    alerts = alerts_frame(spark, ATTACKERS)
    assert rows(profile.repeat_attackers(alerts)) == [("a", 3), ("c", 2)]
    known = spark.createDataFrame([("a",)], "src_ip string")
    assert rows(profile.without_profile(profile.repeat_attackers(alerts), known)) == [("c", 2)]


def test_sequence(spark, rows):
    alerts = shuffled(alerts_frame(spark, ATTACKERS))
    steps = profile.attack_sequence(alerts)
    assert rows(steps) == [
        ("a", 1, "dos"), ("a", 2, "unknown"), ("a", 3, "unknown"),
        ("c", 1, "exploit"), ("c", 2, "port_scan")]
    text = rows(profile.sequence_text(steps, steps_per_row=2))
    assert text == [
        ("a", 0, 2, "dos → unknown"), ("a", 1, 1, "unknown"), ("c", 0, 2, "exploit → port_scan")]


def test_profile_facts(spark):
    facts = profile.profile_facts(profile.port_facts(alerts_frame(spark, ATTACKERS)))
    got = {r["src_ip"]: r for r in facts.collect()}
    assert set(got) == {"a", "c"}
    a, c = got["a"], got["c"]
    assert (a["attack_count"], a["ports_targeted"], a["hack_ports"], a["max_risk"]) == (
        3, "22, 80, 443", "22, 80", 9)
    assert a["first_seen"] == datetime(2026, 5, 29, 8, 0, 0)
    assert (a["last_seen"].second, a["last_hack"].second) == (3, 2)
    assert (c["ports_targeted"], c["attack_types"]) == ("none", ["exploit", "port_scan"])


def test_facts_of_parts_merge_to_facts_of_the_whole(spark, rows):
    alerts = alerts_frame(spark, ATTACKERS)
    parts = [profile.port_facts(alerts.filter(F.col("id") % 2 == n)) for n in (0, 1)]
    whole = profile.profile_facts(profile.port_facts(alerts))
    assert rows(profile.profile_facts(parts[0].unionByName(parts[1]))) == rows(whole)


def test_attacker_profile_orders(spark):
    records = [
        {"src_ip": "a", "attack_type": t, "signature": s, "dst_port": p,
         "timestamp": ts, "created_at": datetime(2026, 5, 29, 8, 0, 0), "risk_score": k}
        for k, (t, s, p, ts) in enumerate([
            ("dos", "S2", 443, "t9"), ("port_scan", "S1", 22, "t1"), ("dos", "S2", None, "t5"),
            (None, "S3", 443, "t4"), ("port_scan", "S1", 22, "t0")])
    ]
    alerts = alerts_frame(spark, records)
    for frame in (alerts, shuffled(alerts), shuffled(alerts, 3)):
        row = profile.attacker_profile(frame).first()
        assert row["total"] == 5 and row["max_risk"] == 4 and row["threat_level"] == "HIGH"
        assert row["attack_types"] == ["dos", "port_scan", None]
        assert row["signatures"] == ["S2", "S1", "S3"]
        assert row["ports"] == [None, 22, 443]
        assert (row["time_start"], row["time_end"]) == ("t9", "t0")
        assert row["kill_chain"] == ["Reconnaissance", "Disruption"]


def test_profiles_follow_the_newest_but_cover_everything(spark, rows):
    alerts = alerts_frame(spark, [{"src_ip": "old"}] + [{"src_ip": "new"}] * 3)
    seen = newest_alerts(alerts, 2)
    assert rows(current_profiles(alerts, seen, 2), "src_ip", "total") == [("new", 3)]
    everyone = current_profiles(alerts, newest_alerts(alerts, None), None)
    assert rows(everyone, "src_ip", "total") == [("new", 3), ("old", 1)]


def test_no_hacks_no_profile(spark):
    alerts = alerts_frame(spark, [{"llm_classification": "normal"}])
    assert profile.attacker_profile(alerts).count() == 0
    view = analyst_view(alerts)
    assert view["attackers"].count() == 0
    assert view["kpis"].first()["total"] == 1
    assert view["accuracy_overall"].first()["accuracy"] == 0


def test_newest_positive_ttl(spark, rows):
    alerts = alerts_frame(spark, [
        {"src_ip": "a", "ttl": 64}, {"src_ip": "a", "ttl": 128}, {"src_ip": "a", "ttl": 0},
        {"src_ip": "b", "ttl": 0}, {"src_ip": "c", "ttl": None}, {"src_ip": "c", "ttl": 255},
    ])
    assert rows(profile.attacker_os(alerts)) == [
        ("a", 128, "Windows"), ("b", 0, "Unknown"), ("c", 255, "Network Device")]


def test_ttl_join_tells_unknown_from_null(spark, rows):
    order = "source_order struct<rank:int,file:string,block:bigint,line:bigint>"
    records = spark.createDataFrame(
        [("a", 64, (0, "f", 0, 1)), ("a", 32, (0, "f", 0, 2)), ("n", 5, (0, "f", 0, 1)),
         ("n", None, (0, "f", 0, 2))], f"src_ip string, ttl bigint, {order}")
    alerts = spark.createDataFrame([("a",), ("n",), ("x",)], "src_ip string")
    joined = enrich.join_ttl(alerts, enrich.latest_ttl(records))
    assert rows(joined) == [("a", 32), ("n", None), ("x", 0)]


# --- scoring ------------------------------------------------------------------


def test_scorer_defaults_nulls_and_failures(spark):
    def scorer(batch: pd.DataFrame):
        if (batch["src_ip"] == "bad").any():
            raise RuntimeError("down")
        return [
            {"classification": "hack", "risk_score": "7"} if ip == "part"
            else {"classification": None, "risk_score": None, "explanation": "e",
                  "attack_type": "dos", "false_positive_likelihood": 3.0}
            for ip in batch["src_ip"]
        ]

    frame = alerts_frame(spark, [{"src_ip": ip} for ip in ("part", "bad", "null", "part")])
    bare = frame.drop("llm_classification", "attack_type", "explanation", "risk_score",
                      "false_positive_likelihood")
    got = score.score_alerts(bare, scorer).orderBy("id").collect()
    verdicts = [tuple(r[c] for c in ("llm_classification", "attack_type", "explanation",
                                     "risk_score", "false_positive_likelihood")) for r in got]
    part = ("hack", "unknown", "", 7, 50)
    assert verdicts == [part, ("error", "unknown", "API unreachable", 5, 50),
                        (None, "dos", "e", None, 3), part]
    assert [r["src_ip"] for r in got] == ["part", "bad", "null", "part"]


def test_scorer_may_return_a_frame(spark):
    def scorer(batch: pd.DataFrame):
        return pd.DataFrame({"classification": ["normal"] * len(batch), "risk_score": [1] * len(batch)})

    got = score.score_alerts(alerts_frame(spark, [{}] * 5), scorer, batch_rows=2).collect()
    assert {(r["llm_classification"], r["risk_score"], r["attack_type"]) for r in got} == {
        ("normal", 1, "unknown")}


def test_scorer_with_wrong_number_of_answers(spark):
    got = score.score_alerts(alerts_frame(spark, [{}] * 3), lambda batch: []).collect()
    assert {r["llm_classification"] for r in got} == {"error"}


def test_assessor(spark, rows):
    facts = profile.profile_facts(profile.port_facts(alerts_frame(spark, ATTACKERS)))
    rules = rows(score.assess_profiles(facts), "src_ip", "methodology", "skill_level",
                 "recommended_response")
    assert rules == [("a", "unknown", "SCRIPT KIDDIE", "Block a"),
                     ("c", "unknown", "SCRIPT KIDDIE", "Block c")]

    def assessor(batch: pd.DataFrame):
        if (batch["src_ip"] == "c").any():
            raise RuntimeError("down")
        return [{"objective": "x", "recommended_response": None} for _ in range(len(batch))]

    given = rows(score.assess_profiles(facts, assessor), "src_ip", "methodology", "objective",
                 "recommended_response")
    assert given == [("a", "unknown", "x", None), ("c", "unknown", "unknown", "Block c")]


@pytest.mark.parametrize("priority, signature, verdict, risk", [
    (1, "NMAP scan", "hack", 9), (2, "NMAP scan", "hack", 7), (3, "NMAP scan", "hack", 4),
    (1, "Hello", "normal", 9), (3, "SURICATA SMB", "normal", 1)])
def test_rule_verdict(spark, priority, signature, verdict, risk):
    frame = alerts_frame(spark, [{"priority": priority, "signature": signature}])
    row = score.score_alerts(frame).first()
    assert (row["llm_classification"], row["risk_score"]) == (verdict, risk)


def test_numbering_all_rows_moves_them_once(spark):
    """Joined on the few numbers of partitions, they would meet in as many tasks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = with_position(spark.range(1000).repartition(3), ["id"])
        assert numbered.filter("position != id + 1").isEmpty()
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

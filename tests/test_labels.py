import pytest
from pyspark.sql import functions as F

from palisade import fixed_values as fixed
from palisade.functions import assessment, bands, labels


def value(spark, column, **inputs):
    """``column`` over one row of typed inputs."""
    types = {str: "string", int: "bigint", float: "double", type(None): "bigint", list: "array<string>"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in inputs.items())
    return spark.createDataFrame([tuple(inputs.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "signature, expected",
    [
        ("NMAP SYN Scan Detected", "port_scan"),
        ("xmas tree", "port_scan"),
        ("Hydra login", "brute_force"),
        ("SSH Brute-Force", "brute_force"),
        ("Slowloris DoS Attack", "dos"),
        ("SYN flood", "dos"),
        ("syn scan flood", "port_scan"),
        ("Nikto", "web_scan"),
        ("SQL injection", "web_scan"),
        ("SMB malformed", "exploit"),
        ("Botnet beacon", "malware_c2"),
        ("remote RAT", "malware_c2"),
        ("rate limit", "other"),
        ("ICMP Ping", "info_leak"),
        ("ET INFO something", "info_leak"),
        ("DNS query", "info_leak"),
        ("SURICATA Applayer Detect protocol only one direction", "other"),
        ("", "other"),
    ],
)
def test_attack_type(spark, signature, expected):
    assert value(spark, labels.attack_type(F.col("s")), s=signature) == expected


def test_attack_type_of_null(spark):
    frame = spark.createDataFrame([(None,)], "s string")
    assert frame.select(labels.attack_type(F.col("s"))).first()[0] == "other"


@pytest.mark.parametrize(
    "attack, stage",
    [("dos", "Actions on Objectives"), ("malware_c2", "Command & Control"),
     ("exploit", "Exploitation"), ("other", "Unknown"), ("new", "Unknown")],
)
def test_stage(spark, attack, stage):
    assert value(spark, labels.kill_chain_stage(F.col("a")), a=attack) == stage


@pytest.mark.parametrize(
    "signature, priority, flow_bytes, with_flows, score",
    [
        ("plain", 1, 5, True, 0),
        ("suricata x", 1, 5, True, 40),
        ("x SURICATA", 1, 5, True, 0),
        ("plain", 3, 5, True, 30),
        ("ET INFO x", 1, 5, True, 20),
        ("packet policy", 1, 5, True, 20),
        ("plain", 1, 0, True, 10),
        ("plain", 1, None, True, 0),
        ("plain", 1, None, False, 10),
        ("ET POLICY x", 3, 5, True, 50),
        ("ET POLICY x", 3, 0, True, 60),
        ("SURICATA ET INFO", 3, 0, True, 100),
    ],
)
def test_fp_likelihood(spark, signature, priority, flow_bytes, with_flows, score):
    column = labels.fp_likelihood(F.col("s"), F.col("p"), F.col("f") if with_flows else None)
    assert value(spark, column, s=signature, p=priority, f=flow_bytes) == score
    truth = labels.ground_truth(column)
    expected = "false_positive" if score >= 60 else "true_positive"
    assert value(spark, truth, s=signature, p=priority, f=flow_bytes) == expected


@pytest.mark.parametrize(
    "ttl, os",
    [(-1, "Linux/Unix"), (0, "Unknown"), (64, "Linux/Unix"), (65, "Windows"),
     (128, "Windows"), (129, "Network Device"), (255, "Network Device"),
     (256, "Unknown"), (None, "Unknown")],
)
def test_os(spark, ttl, os):
    assert value(spark, bands.os_family(F.col("t")), t=ttl) == os


def test_bands(spark):
    assert [value(spark, bands.risk_class(F.col("r")), r=r) for r in (8, 7, 5, 4)] == [
        "critical", "warning", "warning", "safe"]
    assert [value(spark, bands.risk_color(F.col("r")), r=r) for r in (8, 5, 4)] == [
        "red", "amber", "green"]
    assert [value(spark, bands.fp_band(F.col("r")), r=r) for r in (70, 69, 40, 39)] == [
        "red", "amber", "amber", "green"]
    assert [value(spark, bands.severity_flag(F.col("r")), r=r) for r in (7, 6, None)] == [
        "severe", "notice", "notice"]
    assert [value(spark, bands.threat_level(F.col("r")), r=r) for r in (8, 7)] == [
        "CRITICAL", "HIGH"]
    assert [value(spark, bands.accuracy_status(F.col("r")), r=r) for r in (80, 79, 50, 49)] == [
        "pass", "warn", "warn", "fail"]


@pytest.mark.parametrize(
    "part, whole, decimals, expected",
    [(0, 0, 0, 0), (1, 8, 0, 12), (3, 8, 0, 38), (1, 3, 1, 33.3), (2, 3, 0, 67), (0, 0, 1, 0.0)],
)
def test_percent(spark, part, whole, decimals, expected):
    got = value(spark, bands.percent(F.col("a"), F.col("b"), decimals), a=part, b=whole)
    assert got == expected


def test_shortened(spark):
    assert value(spark, bands.shortened(F.col("s"), 3), s="abc") == "abc"
    assert value(spark, bands.shortened(F.col("s"), 3), s="abcd") == "abc…"


@pytest.mark.parametrize(
    "types, steps, objective, skill",
    [
        ([], [], "Reconnaissance", "SCRIPT KIDDIE"),
        (["other", None], [], "Reconnaissance", "SCRIPT KIDDIE"),
        (["port_scan"], ["Reconnaissance"], "Reconnaissance", "SCRIPT KIDDIE"),
        (["dos"], ["Disruption"], "Service", "SCRIPT KIDDIE"),
        (["web_attack"], ["Web Exploitation"], "Reconnaissance", "SCRIPT KIDDIE"),
        (["exploit", "dos", "port_scan"], ["Reconnaissance", "Disruption", "Exploitation"],
         "Systematic", "INTERMEDIATE"),
        (["brute_force", "web_scan"], ["Credential Attack", "Web Exploitation"],
         "Reconnaissance", "SCRIPT KIDDIE"),
    ],
)
def test_assessment(spark, types, steps, objective, skill):
    got = assessment.profile_steps(F.col("t"))
    assert value(spark, got, t=types) == steps
    assert value(spark, assessment.rule_objective(got), t=types).startswith(objective)
    assert value(spark, assessment.rule_skill(got), t=types) == skill
    text = value(spark, assessment.steps_text(got), t=types)
    assert text == (" → ".join(steps) if steps else "Undetermined")


def test_unknown_label_shows_itself(spark):
    assert value(spark, labels.attack_label(F.col("a")), a="dos") == "DoS"
    assert value(spark, labels.attack_label(F.col("a")), a="info_leak") == "info_leak"


def test_pieces_a_match_needs():
    assert labels.needed_pieces(r"port.?scan|nmap|udp.?scan|rat\b") == ["port", "nmap", "scan", "rat"]
    for pattern in (r"a.*b", r"(a|b)c", r"x|.?", r"\d+|y", r"a[bc]"):
        assert labels.needed_pieces(pattern) == []


def test_patterns_are_matched_only_where_their_pieces_occur(spark):
    texts = [a + x + b for a in ("", "ET ") for b in ("", "s") for pattern, _ in fixed.ATTACK_TYPE_PATTERNS
             for alternative in pattern.split("|") for word in [alternative.replace("\\b", "")]
             for x in (word.replace(".?", ""), word.replace(".?", "-").upper(), word.replace(".?", "--"))]
    frame = spark.createDataFrame([(x,) for x in [*texts, None, "", "port", "scan"]], "s string")
    text, ladder = F.lower("s"), F.lit(fixed.OTHER_ATTACK)
    for pattern, label in reversed(fixed.ATTACK_TYPE_PATTERNS):
        ladder = F.when(text.rlike(pattern), F.lit(label)).otherwise(ladder)
    found = frame.select(labels.attack_type(F.col("s")).alias("got"), ladder.alias("expected"))
    assert found.filter("NOT got <=> expected").isEmpty()
    plan = found.select("got")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Contains(") < plan.index("RLIKE"), plan

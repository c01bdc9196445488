"""Hand-made frames for the unit tests."""

from datetime import datetime

from pyspark.sql import functions as F

from palisade.schemas import ALERTS, SOURCE_ORDER

LINE = (
    "03/14/2027-21:07:45.310992  [**] [1:9000777:1] NMAP SYN Scan Detected [**] "
    "[Classification: Probe Of Open Services] [Priority: 2] {TCP} "
    "172.20.4.9:51311 -> 172.20.8.30:8080"
)


def lines_frame(spark, values, rank=0):
    """Lines in list order."""
    data = [(v, (rank, "f", 0, n)) for n, v in enumerate(values)]
    return spark.createDataFrame(data, f"value string, source_order {SOURCE_ORDER.simpleString()}")


def alerts_frame(spark, records):
    """Stored alerts from dicts; id and created_at rise with the position."""
    defaults = {
        "timestamp": "t", "signature": "s", "src_ip": "1.1.1.1", "dst_ip": "2.2.2.2",
        "src_port": 1, "dst_port": 80, "protocol": "TCP", "priority": 1,
        "classification_suricata": "c", "llm_classification": "hack",
        "attack_type": "dos", "explanation": "", "risk_score": 5,
        "false_positive_likelihood": 0, "ttl": 0,
    }
    data = []
    for n, record in enumerate(records):
        row = {"id": n, "created_at": datetime(2026, 5, 29, 8, 0, n % 60), **defaults, **record}
        data.append(tuple(row[name] for name in ALERTS.fieldNames()))
    return spark.createDataFrame(data, ALERTS)


def shuffled(df, partitions=7):
    """Same rows, spread at random."""
    return df.repartition(partitions, F.rand(seed=partitions))

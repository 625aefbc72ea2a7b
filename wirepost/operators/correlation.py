"""Server correlation: preference modes, capability matrix, contradictions, coverage.

A server's sessions can be many, its client signatures and capabilities are few: sessions are aggregated to signatures
before any of them meet, so a hot server sends partial aggregates, never its sessions, to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts as f

#: Protocol versions that a server's coverage is measured over.
APPLICABLE_VERSIONS = (0x0301, 0x0302, 0x0303, 0x0304)
STATE_TIERS = {"DEMONSTRATED": "OBSERVED", "EXCLUDED_FIRM": "DEDUCED", "CONTRADICTED": "DEDUCED", "UNDETERMINED": "NOT_OBSERVABLE"}


def capability(kind: str, code: Column) -> Column:
    digits = F.lower(F.hex(code.cast("int")))  # format_string() is several times slower
    return F.concat(F.lit(f"{kind}:0x"), F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0")))


def signatures(offers: DataFrame) -> DataFrame:
    """(server, offered, chosen, first, n): each distinct ordered offer, what it led to, its first session and how many there are."""
    usable = offers.where(F.col("selected").isNotNull() & (F.size("offered") > 0))
    return usable.groupBy("server", "offered").agg(F.sort_array(F.collect_set("selected")).alias("chosen"), F.min("session").alias("first"), F.count("*").alias("n"))


def signature_pairs(offers: DataFrame) -> DataFrame:
    """Pairs of a server's signatures, the earlier first, with the suites that both offer in the order of either."""
    place = F.row_number().over(Window.partitionBy("server").orderBy("first", "offered"))
    one = signatures(offers).withColumn("i", place)
    a = one.select(F.col("server"), F.col("i").alias("i"), F.col("offered").alias("offered1"), F.col("chosen").alias("chosen1"))
    b = one.select(F.col("server").alias("server2"), F.col("i").alias("j"), F.col("offered").alias("offered2"), F.col("chosen").alias("chosen2"))
    pairs = a.join(b, (F.col("server") == F.col("server2")) & (F.col("i") < F.col("j"))).drop("server2")
    return pairs.withColumns({"order1": F.array_intersect("offered1", "offered2"), "order2": F.array_intersect("offered2", "offered1")})


def preference_modes(offers: DataFrame) -> DataFrame:
    """(server, mode, shared, alternatives): client_order or server_order by the first pair of signatures that rules the other out, else unknown."""
    shown = offers.where("selected is not null").groupBy("server").agg(F.collect_set("selected").alias("demonstrated"))
    pairs = signature_pairs(offers).where((F.size("order1") >= 2) & (F.col("order1") != F.col("order2")) & (F.size("chosen1") == 1) & (F.size("chosen2") == 1))
    met = pairs.join(shown.withColumnRenamed("server", "server3"), F.col("server") == F.col("server3"))
    one, two = F.element_at("chosen1", 1), F.element_at("chosen2", 1)
    proven = F.sort_array(F.array_intersect(F.array_except("order1", F.array(one)), "demonstrated"))
    client = (one == F.element_at("order1", 1)) & (two == F.element_at("order2", 1)) & (one != two)
    server = (one == two) & (F.size(proven) > 0)
    mode = F.when(client, "client_order").when(server, "server_order")
    found = met.withColumns({"mode": mode, "shared": F.sort_array("order1"), "alternatives": F.when(server & ~client, proven)}).where("mode is not null")
    best = found.groupBy("server").agg(F.min_by(F.struct("mode", "shared", "alternatives"), F.struct("i", "j")).alias("best"))
    return shown.select("server").join(best, "server", "left").select("server", F.coalesce("best.mode", F.lit("unknown")).alias("mode"), "best.shared", "best.alternatives")


def observations(offers: DataFrame, modes: DataFrame) -> DataFrame:
    """(server, capability, sign, session): 1 for shown, -1 for firmly excluded, 0 for merely offered."""
    chosen = offers.where("selected is not null").select("server", capability("cipher", F.col("selected")).alias("capability"), F.lit(1).alias("sign"), "session")
    version = offers.where("version is not null").select("server", capability("version", F.col("version")).alias("capability"), F.lit(1).alias("sign"), "session")
    versions = offers.select("server", "session", "version", F.explode("versions").alias("v")).select(
        "server", capability("version", F.col("v")).alias("capability"), F.when(F.col("v") > F.col("version"), -1).otherwise(0).alias("sign"), "session"
    )
    clients = modes.where("mode = 'client_order'").select(F.col("server").alias("client"))
    ordered = offers.join(clients, F.col("server") == F.col("client"), "left")
    place = F.array_position("offered", F.col("selected"))
    suites = ordered.select("server", "session", "selected", "client", place.alias("place"), F.posexplode("offered").alias("p", "c")).where("selected is null or c <> selected")
    passed = F.when(F.col("client").isNotNull() & (F.col("place") > 0) & (F.col("p") + 1 < F.col("place")), -1).otherwise(0)
    others = suites.select("server", capability("cipher", F.col("c")).alias("capability"), passed.alias("sign"), "session")
    return chosen.unionByName(version).unionByName(versions).unionByName(others)


def support_matrix(offers: DataFrame, modes: DataFrame) -> DataFrame:
    """(server, capability, state, tier, positive, negative): what all sessions together say; positive and negative count them."""
    seen = observations(offers, modes).groupBy("server", "capability").agg(F.count_if(F.col("sign") == 1).alias("positive"), F.count_if(F.col("sign") == -1).alias("negative"))
    up, down = F.col("positive") > 0, F.col("negative") > 0
    state = F.when(up & down, "CONTRADICTED").when(up, "DEMONSTRATED").when(down, "EXCLUDED_FIRM").otherwise("UNDETERMINED")
    cells = seen.withColumn("state", state)
    return cells.select("server", "capability", "state", f.lookup(F.col("state"), STATE_TIERS).alias("tier"), "positive", "negative")


def deduced_coverage(matrix: DataFrame) -> DataFrame:
    """(server, settled, percent): applicable versions that are shown or firmly excluded; contradicted ones aren't settled."""
    names = [f"version:0x{v:04x}" for v in APPLICABLE_VERSIONS]
    settled = F.count_if(F.col("capability").isin(*names) & F.col("state").isin("DEMONSTRATED", "EXCLUDED_FIRM"))
    return matrix.groupBy("server").agg(settled.alias("settled")).withColumn("percent", f.percent(F.col("settled"), F.lit(len(names))))


def negotiate(offered: Column, supported: Column, server_order: Column) -> Column:
    """The first mutual suite in the server's order or the client's; null if there is none."""
    by_server, by_client = F.array_intersect(supported, offered), F.array_intersect(offered, supported)
    return F.try_element_at(F.when(server_order, by_server).otherwise(by_client), F.lit(1))

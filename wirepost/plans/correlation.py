"""Queries of the correlation operators over lineitem, and of the registry lookups over part and supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation as c
from .bridge import OFFERS_SQL, SUITE_A, SUITE_B, offers, table


def _matrix(s, d):
    rows = offers(s, d)
    return c.support_matrix(rows, c.preference_modes(rows))


def win_13(s, d):
    place = F.array_position("offered", F.col("selected"))
    return offers(s, d).groupBy("server", place.cast("int").alias("place")).agg(F.count("*").alias("n"))


def jon_20(s, d):
    """Suites and versions that one session selected together."""
    return offers(s, d).groupBy("server", "version", "selected").agg(F.count("*").alias("n"))


def jon_13(s, d):
    """Contradicted capabilities with the number of sessions on either side."""
    return _matrix(s, d).where("state = 'CONTRADICTED'").select("server", "capability", "positive", "negative")


def agg_34(s, d):
    states = s.createDataFrame([(x,) for x in c.STATE_TIERS], "state string")
    return states.join(_matrix(s, d).groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def registry(s):
    """Code points that the projected tables use; others are deliberate misses."""
    rows = [(v, name, kind, order) for v, (name, kind, order) in enumerate([("x25519", "CLASSICAL", 4), ("secp256r1", "CLASSICAL", 3), ("X25519MLKEM768", "PQ_HYBRID", 5), ("SSL3.0", "CLASSICAL", None), ("x25519kyber", "PQ_OBSOLETE_DRAFT", 1)])]
    return F.broadcast(s.createDataFrame(rows, "code int, name string, class string, ordinal int"))


REGISTRY_SQL = "(VALUES (0, 'x25519', 'CLASSICAL', 4), (1, 'secp256r1', 'CLASSICAL', 3), (2, 'X25519MLKEM768', 'PQ_HYBRID', 5), (3, 'SSL3.0', 'CLASSICAL', NULL), (4, 'x25519kyber', 'PQ_OBSOLETE_DRAFT', 1)) g(code, name, class, ordinal)"


def jon_10(s, d):
    parts = table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 7).cast("int").alias("key"))
    met = parts.join(registry(s), F.col("key") == F.col("code"), "left")
    name = F.coalesce("name", F.format_string("UNKNOWN_0x%04X", F.col("key")))
    return met.select("p_partkey", name.alias("name"), F.coalesce("class", F.lit("UNKNOWN")).alias("class"))


def jon_11(s, d):
    """Names back to code points: present and known, present and unknown, absent."""
    names = F.element_at(F.array(*map(F.lit, ("x25519", "secp256r1", "nosuch", None))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = table(s, d, "supplier").select("s_suppkey", names.alias("wanted"))
    return rows.join(registry(s), F.col("wanted") == F.col("name"), "left").select("s_suppkey", "code", F.when(F.col("wanted").isNotNull(), F.col("code").isNotNull()).alias("known"))


def mth_01(s, d):
    """Downgrade: how far below the best known offer the selection is; null if either is unknown."""
    parts = table(s, d, "part").select("p_partkey", (F.col("p_size") % 6).cast("int").alias("best"), (F.col("p_partkey") % 5).cast("int").alias("chosen"))
    one, two = (registry(s).select(F.col("code").alias(f"c{k}"), F.col("ordinal").alias(f"o{k}")) for k in (1, 2))
    met = parts.join(one, F.col("best") == F.col("c1"), "left").join(two, F.col("chosen") == F.col("c2"), "left")
    delta = F.when(F.col("o1").isNotNull() & F.col("o2").isNotNull(), F.greatest(F.lit(0), F.col("o1") - F.col("o2")))
    return met.select("p_partkey", delta.alias("delta"))


def dom_20(s, d):
    supported = F.when(F.col("server") % 2 == 0, F.array(F.lit(SUITE_B), F.lit(SUITE_A))).otherwise(F.array(F.lit(SUITE_A)))
    pick = c.negotiate(F.col("offered"), supported, F.col("server") % 4 == 0)
    return offers(s, d).groupBy("server", pick.alias("picked")).agg(F.count("*").alias("n"))


def agg_37(s, d):
    joined = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("nations"))


QUERIES = {
    "agg_19": _matrix,
    "agg_20": lambda s, d: c.deduced_coverage(_matrix(s, d)),
    "agg_22": jon_13,
    "agg_33": lambda s, d: offers(s, d).groupBy("server").agg(F.sort_array(F.collect_set("selected")).alias("suites")),
    "agg_34": agg_34,
    "agg_35": lambda s, d: c.preference_modes(offers(s, d)).groupBy("mode").agg(F.count("*").alias("n")),
    "agg_37": agg_37,
    "dom_10": lambda s, d: c.preference_modes(offers(s, d)),
    "dom_20": dom_20,
    "flt_05": lambda s, d: table(s, d, "part").select("p_partkey", F.filter(F.array("p_size", F.col("p_size") * 0x0A0A, F.lit(0x1A1A)), lambda x: ~((x % 256 == F.shiftright(x, 8)) & (x % 16 == 10))).alias("kept")),
    "flt_06": lambda s, d: offers(s, d).groupBy("server").agg(F.count_if(F.exists("offered", lambda x: x == SUITE_A)).alias("flagged"), F.count_if(F.size(F.filter("offered", lambda x: x != SUITE_A)) == 0).alias("emptied")),
    "jon_10": jon_10,
    "jon_11": jon_11,
    "jon_14": lambda s, d: c.signature_pairs(offers(s, d)).select("server", "i", "j", "offered1", "offered2"),
    "jon_20": jon_20,
    "mth_01": mth_01,
    "prj_14": lambda s, d: offers(s, d).select(c.capability("cipher", F.col("selected")).alias("capability")).distinct(),
    "set_01": lambda s, d: c.signature_pairs(offers(s, d)).where(F.size("order1") >= 2).select("server", "i", "j", F.sort_array("order1").alias("shared")),
    "set_02": lambda s, d: c.signature_pairs(offers(s, d)).select("server", "i", "j", F.sort_array(F.array_except("order1", "chosen1")).alias("alternatives")),
    "set_03": lambda s, d: c.signature_pairs(offers(s, d)).select("server", "i", "j", F.sort_array(F.array_intersect("order1", F.array_union("chosen1", "chosen2"))).alias("demonstrated")),
    "set_04": lambda s, d: c.observations(offers(s, d), c.preference_modes(offers(s, d))).select("server", "capability").distinct(),
    "set_07": lambda s, d: offers(s, d).select(F.array_distinct(F.concat("offered", "offered")).alias("offered")).distinct(),
    "win_13": win_13,
}
OFF = f"WITH o AS ({OFFERS_SQL})"
SIG = f"""{OFF}, g AS (SELECT server, offered, list_sort(list(DISTINCT selected)) AS chosen, min(session) AS first FROM o GROUP BY server, offered),
    n AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY first, offered) AS i FROM g),
    p AS (SELECT a.server, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, a.offered AS offered1, b.offered AS offered2, a.chosen AS chosen1, b.chosen AS chosen2,
                 list_filter(a.offered, lambda x: list_contains(b.offered, x)) AS order1, list_filter(b.offered, lambda x: list_contains(a.offered, x)) AS order2
          FROM n a JOIN n b ON a.server = b.server AND a.i < b.i)"""
MODES = f"""{SIG}, w AS (SELECT server, list(DISTINCT selected) AS shown FROM o GROUP BY server),
    q AS (SELECT p.*, chosen1[1] AS x, chosen2[1] AS y, list_sort(list_filter(order1, lambda z: z <> chosen1[1] AND list_contains(shown, z))) AS proven
          FROM p JOIN w USING (server) WHERE len(order1) >= 2 AND order1 <> order2 AND len(chosen1) = 1 AND len(chosen2) = 1),
    r AS (SELECT *, CASE WHEN x = order1[1] AND y = order2[1] AND x <> y THEN 'client_order' WHEN x = y AND len(proven) > 0 THEN 'server_order' END AS mode FROM q),
    b AS (SELECT DISTINCT ON (server) server, mode, list_sort(order1) AS shared, CASE WHEN mode = 'server_order' THEN proven END AS alternatives FROM r WHERE mode IS NOT NULL ORDER BY server, i, j),
    m AS (SELECT w.server, coalesce(mode, 'unknown') AS mode, shared, alternatives FROM w LEFT JOIN b USING (server))"""
MATRIX = f"""{MODES}, e AS (SELECT o.*, m.mode FROM o JOIN m USING (server)),
    z AS (SELECT server, printf('cipher:0x%04x', selected) AS capability, 1 AS sign FROM e
          UNION ALL SELECT server, printf('version:0x%04x', version), 1 FROM e
          UNION ALL SELECT server, printf('version:0x%04x', v), CASE WHEN v > version THEN -1 ELSE 0 END FROM (SELECT server, version, unnest(versions) AS v FROM e)
          UNION ALL SELECT server, printf('cipher:0x%04x', c), CASE WHEN mode = 'client_order' AND k < list_position(offered, selected) THEN -1 ELSE 0 END
                    FROM (SELECT server, mode, offered, selected, unnest(offered) AS c, generate_subscripts(offered, 1) AS k FROM e) WHERE c <> selected),
    t AS (SELECT server, capability, count(*) FILTER (WHERE sign = 1) AS positive, count(*) FILTER (WHERE sign = -1) AS negative FROM z GROUP BY ALL),
    x AS (SELECT *, CASE WHEN positive > 0 AND negative > 0 THEN 'CONTRADICTED' WHEN positive > 0 THEN 'DEMONSTRATED' WHEN negative > 0 THEN 'EXCLUDED_FIRM' ELSE 'UNDETERMINED' END AS state FROM t)"""
ORACLES = {
    "agg_19": f"{MATRIX} SELECT server, capability, state, CASE state WHEN 'DEMONSTRATED' THEN 'OBSERVED' WHEN 'UNDETERMINED' THEN 'NOT_OBSERVABLE' ELSE 'DEDUCED' END AS tier, positive, negative FROM x",
    "agg_20": f"""{MATRIX}, c AS (SELECT server, count(*) FILTER (WHERE capability IN ('version:0x0301', 'version:0x0302', 'version:0x0303', 'version:0x0304') AND state IN ('DEMONSTRATED', 'EXCLUDED_FIRM')) AS settled FROM x GROUP BY server)
        SELECT server, settled, CAST(round_even(25.0 * settled, 0) AS INTEGER) AS percent FROM c""",
    "agg_22": f"{MATRIX} SELECT server, capability, positive, negative FROM x WHERE state = 'CONTRADICTED'",
    "agg_33": f"{OFF} SELECT server, list_sort(list(DISTINCT selected)) AS suites FROM o GROUP BY server",
    "agg_34": f"{MATRIX} SELECT v.state, count(x.state) AS n FROM (VALUES ('DEMONSTRATED'), ('EXCLUDED_FIRM'), ('CONTRADICTED'), ('UNDETERMINED')) v(state) LEFT JOIN x ON x.state = v.state GROUP BY v.state",
    "agg_35": f"{MODES} SELECT mode, count(*) AS n FROM m GROUP BY mode",
    "agg_37": "SELECT r_name, list(n_name ORDER BY n_nationkey) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "dom_10": f"{MODES} SELECT * FROM m",
    "dom_20": f"""{OFF}, h AS (SELECT server, offered, CASE WHEN server % 2 = 0 THEN [{SUITE_B}, {SUITE_A}] ELSE [{SUITE_A}] END AS sup FROM o)
        SELECT server, CASE WHEN server % 4 = 0 THEN list_filter(sup, lambda x: list_contains(offered, x))[1] ELSE list_filter(offered, lambda x: list_contains(sup, x))[1] END AS picked, count(*) AS n FROM h GROUP BY ALL""",
    "flt_05": f"SELECT p_partkey, list_filter([p_size, p_size * {0x0A0A}, {0x1A1A}], lambda x: NOT (x % 256 = x // 256 AND x % 16 = 10)) AS kept FROM part",
    "flt_06": f"{OFF} SELECT server, count(*) FILTER (WHERE list_contains(offered, {SUITE_A})) AS flagged, count(*) FILTER (WHERE offered = [{SUITE_A}]) AS emptied FROM o GROUP BY server",
    "jon_10": f"SELECT p_partkey, coalesce(name, printf('UNKNOWN_0x%04X', p_partkey % 7)) AS name, coalesce(class, 'UNKNOWN') AS class FROM part LEFT JOIN {REGISTRY_SQL} ON code = p_partkey % 7",
    "jon_11": f"SELECT s_suppkey, code, CASE WHEN w IS NOT NULL THEN code IS NOT NULL END AS known FROM (SELECT s_suppkey, ['x25519', 'secp256r1', 'nosuch', NULL][s_suppkey % 4 + 1] AS w FROM supplier) LEFT JOIN {REGISTRY_SQL} ON w = name",
    "jon_14": f"{SIG} SELECT server, i, j, offered1, offered2 FROM p",
    "jon_20": f"{OFF} SELECT server, version, selected, count(*) AS n FROM o GROUP BY ALL",
    "mth_01": f"SELECT p_partkey, CASE WHEN a.ordinal IS NOT NULL AND b.ordinal IS NOT NULL THEN greatest(0, a.ordinal - b.ordinal) END AS delta FROM part LEFT JOIN {REGISTRY_SQL.replace(' g(', ' a(')} ON a.code = p_size % 6 LEFT JOIN {REGISTRY_SQL.replace(' g(', ' b(')} ON b.code = p_partkey % 5",
    "prj_14": f"{OFF} SELECT DISTINCT printf('cipher:0x%04x', selected) AS capability FROM o",
    "set_01": f"{SIG} SELECT server, i, j, list_sort(order1) AS shared FROM p WHERE len(order1) >= 2",
    "set_02": f"{SIG} SELECT server, i, j, list_sort(list_filter(order1, lambda x: NOT list_contains(chosen1, x))) AS alternatives FROM p",
    "set_03": f"{SIG} SELECT server, i, j, list_sort(list_filter(order1, lambda x: list_contains(chosen1, x) OR list_contains(chosen2, x))) AS demonstrated FROM p",
    "set_04": f"{MATRIX} SELECT DISTINCT server, capability FROM z",
    "set_07": f"{OFF} SELECT DISTINCT offered FROM o",
    "win_13": f"{OFF} SELECT server, CAST(list_position(offered, selected) AS INTEGER) AS place, count(*) AS n FROM o GROUP BY ALL",
}

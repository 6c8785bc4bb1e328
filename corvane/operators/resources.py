"""Monthly cost of resources: each item's price record by its kind, its project, notes of the owner, waste, and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import values as V
from corvane.operators import totals

# Hours of a month, and the states in which servers are stopped and addresses are free.
HOURS, STOPPED, UNBOUND = 720, ("SHUTOFF", "STOPPED"), ("DOWN", "UNBOUND")


def _one(rows: DataFrame, *keys: str) -> DataFrame:
    """By key the number of records and the first of them."""
    first = F.min(F.struct("id", "payg", "unit", "currency")).alias("r")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), first).select(*keys, "n", "r.*")


def rates(records: DataFrame) -> DataFrame:
    """region, rule, what, n, id, payg, unit, currency: what a server, a disk or an address costs, by what an item says of itself.

    rule ``windows`` or ``linux`` and a flavor; ``disk`` and a type; ``address``. The closer of two rules comes alone: an exact
    Windows before any other, a disk's own flavor before words of names, an address named as one before others."""
    hourly, priced = V.is_hourly(F.col("unit")), F.col("payg").isNotNull()
    os = F.replace(F.lower(F.coalesce("os", F.lit(""))), F.lit(" "), F.lit(""))
    r = records.where(priced).withColumn("os1", os).withColumn("flavor1", F.lower(F.trim(F.coalesce("flavor", F.lit("")))))
    names = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "flavor", "name")), F.lit("[a-z0-9]+"), F.lit(0)))
    servers = r.where(hourly & (F.col("flavor1") != ""))
    gb = r.where((F.col("service") == "evs") & F.lower("unit").contains("gb") & ~hourly)
    address = F.array_contains(names, "eip") | (F.array_contains(names, "ip") & (F.array_contains(names, "elastic") | F.array_contains(names, "public")))
    free = r.where(F.col("service").isin("eip", "vpc") & (F.lower(F.trim("unit")) == "h") & ~F.array_contains(names, "bandwidth") & address)
    rules = [
        (servers.where("os1 = 'windows'"), "windows", 0, F.col("flavor1")), (servers.where("os1 like '%windows%'"), "windows", 1, F.col("flavor1")), (servers.where("os1 = 'openlinux'"), "linux", 0, F.col("flavor1")),
        (gb.where("flavor1 like 'vss.%'"), "disk", 0, F.substring("flavor1", 5, 100)), (gb.withColumn("word", F.explode(names)), "disk", 1, F.col("word")),
        (free.where("flavor1 = 'eip'"), "address", 0, F.lit("")), (free, "address", 1, F.lit("")),
    ]
    found = None
    for rows, rule, order, what in rules:
        part = rows.select("region", F.lit(rule).alias("rule"), F.lit(order).alias("level"), what.alias("what"), "id", "payg", "unit", "currency")
        found = part if found is None else found.unionByName(part)
    by = _one(found, "region", "rule", "what", "level")
    closest = Window.partitionBy("region", "rule", "what").orderBy("level")
    return by.withColumn("nth", F.row_number().over(closest)).where("nth = 1").drop("nth", "level")


def price_items(items: DataFrame, records: DataFrame) -> DataFrame:
    """``items`` with status (priced, stopped, no price), monthly, record and reason.

    items: tenant, handle, kind (ecs, evs, eip or another), region, state, size, os, attached (array), project."""
    disk = F.regexp_extract("size", r"^(\d+) ?GB (\w+)$", 1), F.regexp_extract("size", r"^(\d+) ?GB (\w+)$", 2)
    rule = F.when(F.col("kind") == "ecs", F.when(F.col("os") == "windows", "windows").otherwise("linux")).when(F.col("kind") == "evs", "disk").when(F.col("kind") == "eip", "address")
    what = F.when(F.col("kind") == "ecs", F.lower("size")).when(F.col("kind") == "evs", F.lower(disk[1])).when(F.col("kind") == "eip", F.lit(""))
    asked = items.withColumn("rule", rule).withColumn("what", what).withColumn("gb", F.when(disk[0] != "", disk[0].cast("decimal(12,0)")))
    j = asked.join(rates(records), ["region", "rule", "what"], "left")
    stopped = (F.col("kind") == "ecs") & F.col("state").isin(*STOPPED)
    reason = (
        F.when(F.col("rule").isNull(), "no rule for the kind").when((F.col("kind") == "ecs") & (F.col("what") == ""), "no flavor").when((F.col("kind") == "evs") & F.col("gb").isNull(), "no size")
        .when(F.col("n").isNull(), "no record").when(F.col("n") > 1, "several records").when(~F.coalesce("currency", F.lit("")).isin("", "EUR"), "other currency")
    )
    quantity = F.when(F.col("kind") == "evs", F.col("gb")).otherwise(F.lit(HOURS).cast("decimal(12,0)"))
    out = j.withColumn("reason", F.when(~stopped, reason)).withColumn("status", F.when(stopped, "stopped").when(F.col("reason").isNull(), "priced").otherwise("no price"))
    monthly = F.when(stopped, F.lit(0)).when(F.col("reason").isNull(), F.col("payg") * quantity)
    return out.withColumn("monthly", monthly.cast("decimal(24,6)")).withColumn("record", F.when(F.col("status") == "priced", F.col("id"))).drop("rule", "what", "gb", "n", "id", "payg", "unit", "currency")


def placed_items(items: DataFrame, notes: DataFrame) -> DataFrame:
    """Items with project (a disk without one takes that of the first of its servers that has one), source of the project, the owner's
    note (by tenant and handle, else by handle alone) and the group of waste they belong to, none where a note keeps them.

    notes: handle (``tenant/handle`` or a bare one), note; one a handle."""
    own = F.when(F.col("project").rlike("^[a-z]{3}-[a-z2-7]{4}$"), F.col("project"))
    items = items.withColumn("own", own)
    servers = items.where("kind = 'ecs'").select(F.col("tenant").alias("s_tenant"), F.col("handle").alias("s_handle"), F.col("own").alias("s_project"), F.col("state").isin(*STOPPED).alias("s_stopped"))
    kept = notes.select(F.col("handle").alias("n_handle"), "note")

    def noted(rows: DataFrame, tenant: str, handle: str, name: str) -> DataFrame:
        exact = kept.select(F.col("n_handle").alias("n1"), F.col("note").alias("note1"))
        bare = kept.select(F.col("n_handle").alias("n2"), F.col("note").alias("note2"))
        joined = rows.join(exact, F.concat_ws("/", tenant, handle) == F.col("n1"), "left").join(bare, F.col(handle) == F.col("n2"), "left")
        return joined.withColumn(name, F.coalesce("note1", "note2")).drop("n1", "n2", "note1", "note2")

    tied = items.where("kind = 'evs'").select("tenant", F.col("handle").alias("disk"), F.posexplode("attached").alias("at", "server"))
    tied = noted(tied, "tenant", "server", "server_note").join(servers, (F.col("tenant") == F.col("s_tenant")) & (F.col("server") == F.col("s_handle")), "left")
    tied = tied.groupBy("tenant", F.col("disk").alias("handle")).agg(
        F.min(F.when(F.col("s_project").isNotNull(), F.struct("at", "s_project"))).alias("first"), F.bool_and(F.coalesce("s_stopped", F.lit(False))).alias("all_stopped"), F.bool_or(F.col("server_note").isNotNull()).alias("kept")
    )
    j = noted(items, "tenant", "handle", "note").join(tied, ["tenant", "handle"], "left")
    loose = F.coalesce(F.size("attached") == 0, F.lit(True)) & (F.col("state") != "in-use")
    waste = F.when(F.col("note").isNotNull() | F.coalesce("kept", F.lit(False)), None).when((F.col("kind") == "evs") & F.coalesce("all_stopped", F.lit(False)), "stopped_server_disks").when((F.col("kind") == "evs") & loose, "unattached_disks").when((F.col("kind") == "eip") & F.col("state").isin(*UNBOUND), "unbound_eips")
    from_server = F.when(F.col("kind") == "evs", F.col("first.s_project"))
    source = F.when(F.col("own").isNotNull(), "tag").when(from_server.isNotNull(), "server").otherwise("none")
    return j.withColumn("project", F.coalesce("own", from_server, F.lit("-"))).withColumn("project_source", source).withColumn("waste", waste).drop("own", "first", "all_stopped", "kept")


def cost_totals(priced: DataFrame) -> DataFrame:
    """grouping, kind, project, tenant, waste, amount, n_items, n_no_price: all groupings in one pass."""
    sums = {"amount": F.sum(F.coalesce("monthly", F.lit(0).cast("decimal(24,6)"))), "n_items": F.count(F.lit(1)), "n_no_price": F.count_if(F.col("status") == "no price")}
    return totals.grouping_totals(priced, [[], ["kind"], ["project"], ["tenant"], ["waste"]], sums)

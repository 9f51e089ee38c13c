"""Matching of disclosed names with members, and members' sectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import fold, name_text, name_tokens

# Sector by the first keyword in a committee's name, and sectors by priority.
COMMITTEE_SECTORS = {
    "armed services": "Defense", "veterans": "Defense", "intelligence": "Defense", "homeland security": "Defense",
    "energy": "Energy", "natural resources": "Energy", "environment": "Energy",
    "financial services": "Finance", "banking": "Finance", "finance": "Finance", "budget": "Finance", "ways and means": "Finance", "appropriations": "Finance",
    "science": "Technology", "technology": "Technology", "commerce": "Technology",
    "health": "Healthcare",
    "agriculture": "Other", "education": "Other", "judiciary": "Other", "foreign affairs": "Other", "foreign relations": "Other", "oversight": "Other",
    "rules": "Other", "ethics": "Other", "administration": "Other", "small business": "Other",
    "transportation": "Industrials", "infrastructure": "Industrials",
}
SECTORS = ("Defense", "Energy", "Finance", "Technology", "Healthcare", "Industrials", "Other")


def committee_sector(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    out = None
    for keyword, sector in COMMITTEE_SECTORS.items():
        test = F.contains(low, F.lit(keyword))
        out = F.when(test, sector) if out is None else out.when(test, sector)
    return out.otherwise("Other")


def sectors(committees: Column) -> Column:
    """Sectors of a committee list by priority; Other only when there is nothing else."""
    found = F.transform(committees, committee_sector)
    real = F.filter(F.array(*(F.lit(s) for s in SECTORS[:-1])), lambda s: F.array_contains(found, s))
    return F.when(F.size(real) > 0, real).otherwise(F.array(F.lit("Other")))


def split_name(name: Column) -> Column:
    """struct(first, last) of a display name: "Last, First" when something but a suffix follows the comma, else first and last word."""
    given, whole = name_text(F.regexp_extract(name, r"^[^,]*,(.*)$", 1)), name_text(name)
    comma, several = given != "", F.contains(whole, F.lit(" "))
    return F.struct(
        F.when(comma, given).when(several, F.substring_index(whole, " ", 1)).otherwise("").alias("first"),
        F.when(comma, name_text(F.regexp_extract(name, r"^([^,]*),", 1))).otherwise(F.substring_index(whole, " ", -1)).alias("last"),
    )


def member_index(members: DataFrame) -> DataFrame:
    """(member, first, last, aliases, whole, block): one row per token of the surname.

    members: member, and first_name and last_name, or official_name or name to
    take them from.  aliases: given names the member goes by, nicknames in
    quotation marks among them; whole: spellings of the full name.
    """
    have = members.columns
    col = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) if c in have else F.lit("")
    official, shown = col("official_name"), col("name")
    words = name_tokens(shown)
    told = F.when(official != "", split_name(official)).otherwise(
        F.struct(F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ").alias("first"), F.coalesce(F.get(words, F.lit(0)), F.lit("")).alias("last"))
    )
    both = (col("first_name") != "") & (col("last_name") != "")
    named = members.select(
        "member", F.when(both, col("first_name")).otherwise(told["first"]).alias("f"), F.when(both, col("last_name")).otherwise(told["last"]).alias("l"),
        official.alias("official"), shown.alias("shown"),
    )
    nick = F.transform(F.regexp_extract_all("official", F.lit("[\"“]([^\"”]+)[\"”]"), 1), lambda n: F.get(name_tokens(n), F.lit(0)))
    own = F.array(F.get(name_tokens(F.col("f")), F.lit(0)), F.get(name_tokens(split_name(F.col("official"))["first"]), F.lit(0)))
    out = named.select(
        "member", name_tokens(F.col("f")).alias("first"), name_tokens(F.col("l")).alias("last"),
        F.array_distinct(F.filter(F.concat(own, nick), lambda x: x.isNotNull())).alias("aliases"),
        F.array(name_tokens(F.col("official")), name_tokens(F.col("shown")), name_tokens(F.concat_ws(" ", "f", "l"))).alias("whole"),
    ).filter("size(first) > 0 AND size(last) > 0")
    return out.withColumn("block", F.explode(F.array_distinct("last")))


def _same_person(tokens: Column, aliases: Column, last: Column, whole: Column) -> Column:
    """A spelling of the whole name, or the surname at either end with an agreeing given name, at least by its initial.

    Middle names may differ; an initial before longer words is no given name.
    """
    n, k = F.size(tokens), F.size(last)
    behind = F.slice(tokens, F.greatest(n - k + 1, F.lit(1)), k) == last
    ahead = F.slice(tokens, F.lit(1), k) == last
    given = F.when(behind, F.slice(tokens, F.lit(1), F.greatest(n - k, F.lit(0)))).when(ahead, F.slice(tokens, k + 1, F.greatest(n - k, F.lit(0))))
    lead = F.try_element_at(given, F.lit(1))
    initial = F.length(lead) == 1
    odd = initial & F.exists(F.slice(given, F.lit(2), F.greatest(F.size(given) - 1, F.lit(0))), lambda t: F.length(t) > 1)
    agrees = F.exists(aliases, lambda a: (lead == a) | (initial & (lead == F.substring(a, 1, 1))))
    return F.array_contains(whole, tokens) | F.coalesce((n > k) & ~odd & agrees, F.lit(False))


def _people(names: DataFrame, members: DataFrame) -> DataFrame:
    """(name, member) of distinct names that are exactly one member's; they meet members on surname tokens only."""
    tokens = names.select("name").distinct().withColumn("tokens", _tokens_of(F.col("name")))
    blocks = tokens.withColumn("block", F.explode(F.array_distinct("tokens")))
    pairs = blocks.join(member_index(members), "block").filter(_same_person(F.col("tokens"), F.col("aliases"), F.col("last"), F.col("whole")))
    found = pairs.groupBy("name").agg(F.countDistinct("member").alias("n"), F.min("member").alias("member"))
    return found.filter("n = 1").select("name", "member")


def _tokens_of(name: Column) -> Column:
    """Words of a disclosed name, surname last also when it is written "Last, First"."""
    given = name_text(F.regexp_extract(name, r"^[^,]*,(.*)$", 1))
    turned = F.concat_ws(" ", given, name_text(F.regexp_extract(name, r"^([^,]*),", 1)))
    return F.filter(F.split(F.when(given != "", turned).otherwise(name_text(name)), " "), lambda w: w != "")


def flag(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(row_id, name, member) of rows whose name is exactly one member's.

    Members are a small table, and the engine decides whether to broadcast it.
    """
    return rows.join(_people(rows, members), "name").select("row_id", "name", "member")


def same_official(names: DataFrame, official: str, members: DataFrame | None = None) -> DataFrame:
    """The names (name) that mean the official asked for.

    With members both are looked up and compared as members; a name that is no
    one member's, and any name without members, is compared as a person: as
    one whole name, by surname alone, or by surname and given name.
    """
    spark = names.sparkSession
    asked = spark.createDataFrame([(official,)], "name string")
    person = asked.withColumn("official_name", F.col("name")).withColumn("member", F.lit("asked")).drop("name")
    tokens = names.select("name").withColumn("tokens", _tokens_of(F.col("name")))
    index = member_index(person).drop("block").distinct()
    surname = asked.select(name_tokens(F.col("name")).alias("asked_tokens"))
    met = tokens.join(F.broadcast(surname)).join(F.broadcast(index), F.lit(True), "left")
    alone = (F.size("asked_tokens") == 1) & (F.try_element_at("tokens", F.lit(-1)) == F.get("asked_tokens", F.lit(0)))
    like = F.coalesce(_same_person(F.col("tokens"), F.col("aliases"), F.col("last"), F.col("whole")), F.lit(False))
    by_name = met.filter(alone | like | (F.col("tokens") == F.col("asked_tokens"))).select("name")
    if members is None:
        return by_name
    known = _people(names, members)
    own = _people(asked, members).select(F.col("member").alias("asked_member"))
    sure = known.join(F.broadcast(own), F.col("member") == F.col("asked_member")).select("name")
    unsure = by_name.join(known.select("name"), "name", "left_anti")
    return sure.unionByName(unsure).distinct()


def official_sectors(rows: DataFrame, members: DataFrame, official: str = "official_name") -> DataFrame:
    """``rows`` with ``sectors`` of the member an official is: by the exact name, else by the one member it fits, else Other.

    members: as for :func:`member_index`, with ``sectors``.
    """
    names = rows.select(F.col(official).alias("name")).distinct()
    told = members.withColumn("spelling", F.coalesce(*(F.col(c) for c in ("official_name", "name", "member") if c in members.columns)))
    exact = told.groupBy("spelling").agg(F.min("sectors").alias("exact"))
    fuzzy = _people(names, members).join(members.select("member", F.col("sectors").alias("fuzzy")).dropDuplicates(["member"]), "member").drop("member")
    found = names.join(exact, F.col("name") == F.col("spelling"), "left").join(fuzzy, "name", "left")
    found = found.select(F.col("name").alias("sector_name"), F.coalesce("exact", "fuzzy", F.array(F.lit("Other"))).alias("sectors"))
    return rows.join(found, F.col(official).eqNullSafe(F.col("sector_name")), "left").drop("sector_name").withColumn("sectors", F.coalesce("sectors", F.array(F.lit("Other"))))


def with_committees(members: DataFrame, membership: DataFrame, names: DataFrame, key: str = "bioguide_id") -> DataFrame:
    """``members`` with their committees by name and sectors.

    membership: (member_id, committee_id, position); names: (committee_id,
    committee).  A subcommittee counts as its parent, the first four characters
    of its identifier, else as itself; names are listed once, in order.
    """
    n = names.select(F.col("committee_id").alias("c"), F.col("committee").alias("title"))
    parent = F.when(F.length("committee_id") > 4, F.substring("committee_id", 1, 4)).otherwise(F.col("committee_id"))
    met = membership.withColumn("parent", parent).join(n, F.col("parent") == F.col("c"), "left").drop("c").withColumnRenamed("title", "of_parent")
    met = met.join(n, F.col("committee_id") == F.col("c"), "left").withColumn("committee", F.coalesce("of_parent", "title"))
    first = met.filter("coalesce(committee, '') != ''").groupBy("member_id", "committee").agg(F.min("position").alias("position"))
    lists = first.groupBy("member_id").agg(F.array_sort(F.collect_list(F.struct("position", "committee"))).alias("x"))
    lists = lists.select("member_id", F.transform("x", lambda i: i["committee"]).alias("committees"))
    out = members.join(lists, F.col(key) == F.col("member_id"), "left").drop("member_id")
    out = out.withColumn("committees", F.coalesce("committees", F.array().cast("array<string>")))
    return out.withColumn("sectors", sectors(F.col("committees")))


def refresh_members(previous: DataFrame, federal: DataFrame, state: DataFrame, keep_share: float = 0.8) -> DataFrame:
    """The new member list; raises ValueError where a source looks broken.

    No federal members, or under ``keep_share`` of the federal or (if any came)
    state members there were, are refused.  Without new state members the old
    ones stay.  Of one level and identifier (else name and state) the first by
    level, state and name stays.  Columns: level, bioguide_id, openstates_id,
    name, state and others.
    """
    level = F.coalesce("level", F.lit("federal"))
    before = {r["level"]: r["n"] for r in previous.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {"federal": federal.count(), "state": state.count()}
    if not counts["federal"]:
        raise ValueError("no federal members")
    for kind, n in counts.items():
        if (n or kind == "federal") and n < keep_share * before.get(kind, 0):
            raise ValueError(f"{n} {kind} members, where {before[kind]} were known")
    kept = federal.unionByName(state, allowMissingColumns=True)
    if not counts["state"]:
        kept = kept.unionByName(previous.filter(level == "state"), allowMissingColumns=True)
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    own = F.coalesce(blank("bioguide_id"), blank("openstates_id"), F.concat_ws("\u001f", fold(F.col("name")), fold(F.col("state"))))
    order = F.struct((level != "federal").alias("l"), F.coalesce("state", F.lit("")).alias("s"), F.coalesce("name", F.lit("")).alias("n"))
    picked = kept.groupBy(level.alias("_level"), own.alias("_own")).agg(F.min_by(F.struct(*kept.columns), order).alias("x"))
    return picked.select("x.*").orderBy(F.col("level") != "federal", "state", "name")


def demo_members(customer: DataFrame) -> DataFrame:
    """Every third customer as a member: the part before # is the given name, the number the surname."""
    return customer.filter("c_custkey % 3 = 0").selectExpr(
        "c_name AS member", "split(c_name, '#')[0] AS first_name", "split(c_name, '#')[1] AS last_name"
    )


def demo_committee(key: Column) -> Column:
    names = F.array(*(F.lit(n) for n in ("Armed Services", "Energy", "Banking", "Science", "Health", "Rules")))
    return F.element_at(names, (F.pmod(key, F.lit(6)) + 1).cast("int"))

"""Classifications and scalar decodes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of the median gap in days and the cadence they mean.
CADENCE_BANDS = [(1.5, "daily"), (4, "irregular"), (10, "weekly"), (24, "irregular"), (35, "monthly"), (180, "monthly")]
#: Days without a run after which a chain of a cadence no longer counts as live.
LIVE_DAYS = {"hourly": 30, "multiple_daily": 90, "daily": 180, "weekly": 180, "monthly": 395, "irregular": 395, "unknown": 395}
#: Least runs a day of each frequency.
FREQUENCY_BANDS = [(18, "hourly"), (1.5, "multiple_daily"), (0.5, "daily"), (0.08, "weekly"), (0.015, "monthly")]
#: Points a finding costs, and the least score of each grade.
SEVERITY_WEIGHTS = {"critical": 12.0, "high": 6.0, "medium": 2.0, "low": 0.5, "info": 0.0}
GRADES = [(90, "A"), (75, "B"), (60, "C"), (40, "D"), (0, "E")]


def bands(value: Column, limits: list[tuple[float, str]], other: str, upper: bool) -> Column:
    """The first band whose limit the value keeps to (at most the limit if upper, else at least)."""
    out = F.lit(other)
    for limit, name in reversed(limits):
        out = F.when(value <= limit if upper else value >= limit, name).otherwise(out)
    return out


def cadence(run_days: Column, runs: Column, median_gap: Column) -> Column:
    per_day = runs / run_days
    base = bands(median_gap, CADENCE_BANDS, "irregular", upper=True)
    promoted = F.when(base != "daily", base).when(per_day >= 18, "hourly").when(per_day >= 1.5, "multiple_daily").otherwise("daily")
    return F.when(run_days <= 1, "unknown").otherwise(promoted)


def frequency(runs_per_day: Column, runs: Column) -> Column:
    return F.when(runs < 3, "unknown").otherwise(bands(runs_per_day, FREQUENCY_BANDS, "irregular", upper=False))


def is_live(cadence_col: Column, idle_days: Column) -> Column:
    window = F.create_map(*[F.lit(x) for pair in LIVE_DAYS.items() for x in pair])
    return idle_days <= window[cadence_col]


def state_class(state: Column) -> Column:
    return F.when(state.isin("G", "F"), "ok").when(state.isin("R", "J", "X"), "failed").otherwise("indeterminate")


def clock(minutes: Column) -> Column:
    """Minutes of a day as HH:MM."""
    return F.format_string("%02d:%02d", (minutes / 60).cast("int"), (minutes % 60).cast("int"))


def clock_minutes(text: Column) -> Column:
    parts = F.split(text, ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def wrapped_minutes(earlier: Column, later: Column) -> Column:
    return F.pmod(later - earlier, F.lit(1440))


def margin_severity(margin: Column) -> Column:
    return F.when(margin.isNull(), "info").when(margin < 0, "critical").when(margin < 30, "high").otherwise("low")


def description_quality(name: Column, text: Column) -> Column:
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return F.when(blank, "missing").when(F.lower(text).startswith("copy of"), "copy_artifact").when((F.upper(text) == F.upper(name)) | (F.size(F.split(F.trim(text), "\\s+")) < 4), "generic").otherwise("ok")


def auth_value_kind(value: Column) -> Column:
    return F.when(value == "*", "all").when(value == ":", "aggregated").when(value == "#", "unassigned").when(value.startswith("$"), "variable").otherwise("value")


#: Types of objects, the catalogue's codes for them, and other spellings of them.
OBJECT_TYPES = [
    "datasource", "infosource", "transfer_structure", "comm_structure", "dso", "adso", "infocube", "multiprovider", "virtualprovider", "compositeprovider", "openodsview", "infoobject", "transformation", "dtp",
    "infopackage", "update_rule", "routine", "chain", "process", "query", "query_element", "report", "calcview", "source_object", "analysis_auth", "unresolved_dependency", "unknown",
]
OBJECT_CODES = {
    "RSDS": "datasource", "TRCS": "infosource", "ISTS": "transfer_structure", "ODSO": "dso", "ADSO": "adso", "CUBE": "infocube", "MPRO": "multiprovider", "HCPR": "compositeprovider", "IOBJ": "infoobject", "ELEM": "query_element",
    "TRFN": "transformation", "DTPA": "dtp", "ISIP": "infopackage", "UPDR": "update_rule", "RSPC": "chain",
}
OBJECT_ALIASES = {
    "cube": "infocube", "basiccube": "infocube", "other": "unknown", "": "unknown", "iobj": "infoobject", "odso": "dso", "hcpr": "compositeprovider", "mpro": "multiprovider", "rsds": "datasource", "calc_view": "calcview",
    "calculationview": "calcview", "process_chain": "chain", "bex_query": "query",
}


def object_type(value: Column) -> Column:
    """The one spelling of an object's type: a type, a code or another spelling in any case; anything else, and null, is unknown."""
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    known = {c.lower(): t for c, t in OBJECT_CODES.items()} | OBJECT_ALIASES | {t: t for t in OBJECT_TYPES}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[text], F.lit("unknown"))


def object_id(kind: Column, name: Column) -> Column:
    """type:NAME, alike for every spelling of the type and of the name."""
    return F.concat(object_type(kind), F.lit(":"), F.upper(F.trim(name)))


def fingerprint(facts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a map's sorted key=value pairs."""
    pairs = F.array_sort(F.transform(F.map_entries(facts), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return F.substring(F.sha2(F.array_join(pairs, chr(31)), 256), 1, 16)


def name_matches(column: Column, term: str) -> Column:
    """A term with % is a LIKE pattern; any other is looked for anywhere in the name, all its characters literally."""
    wanted = term.strip().upper()
    return F.upper(column).like(wanted) if "%" in wanted else F.instr(F.upper(column), wanted) > 0


#: Classes of generated tables, the suffixes and roles of stores, and the namespaces of generated tables.
MASTER_CLASSES = ["P", "Q", "S", "T", "X", "Y", "M", "H", "K", "I", "J"]
STORE_ROLES = {"1": "inbound", "2": "active", "3": "changelog"}
GENERATED = ["/BIC/", "/BI0/", "/B1H/"]
#: What the icons of the classic request ledger mean, and the codes of the newer one; any other code is unknown in its ledger.
CLASSIC_STATUS = {"@08@": "success", "@09@": "incomplete", "@0A@": "error"}
REQUEST_STATUS = {
    "GG": "success", "YG": "success", "Y": "success", "GR": "incomplete", "U": "incomplete", "N": "incomplete", "RG": "error", "RR": "error", "YR": "error",
    "": "housekeeping", "D": "housekeeping", "M": "housekeeping", "X": "housekeeping",
}
#: Exception aggregations.
EXCEPTIONS = {
    "AV0": "Average (values not equal to zero)", "AV1": "Average (weighted with number of days)", "AV2": "Average (weighted with number of working days; factory calendar)", "AVG": "Average (all values)",
    "CN0": "Counter (values unequal to zero)", "CNT": "Counter (all values)", "FIR": "First value", "LAS": "Last value", "MAX": "Maximum", "MIN": "Minimum", "NO1": "No aggregation (X if more than one record occurs)",
    "NO2": "No aggregation (X if more than one value occurs)", "NOP": "No aggregation (X if more than one value unequal to 0 occurs)", "STD": "Standard deviation", "SUM": "Summation", "VAR": "Variance",
    "NHA": "No aggregation along hierarchy", "NGA": "No aggregation of postable nodes along hierarchy", "MED": "Median", "SLS": "Simple linear regression: slope", "SLI": "Simple linear regression: y-intercept",
    "SLC": "Simple linear regression: correlation coefficient",
}
STOCKS = {"1": "stock_with_change", "2": "stock_with_movements"}


def request_status(ledger: Column, code: Column) -> Column:
    """What a request's code means in its own ledger: the classic one (icons, spelled exactly) or the newer one."""
    icon = F.create_map(*[F.lit(x) for pair in CLASSIC_STATUS.items() for x in pair])[F.trim(F.coalesce(code, F.lit("")))]
    return F.when(ledger == "classic", F.coalesce(icon, F.lit("unknown"))).otherwise(decoded(code, REQUEST_STATUS, "unknown"))


def decoded(code: Column, meanings: dict[str, str], other: str | None = None) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in meanings.items() for x in pair])[F.upper(F.trim(F.coalesce(code, F.lit(""))))], F.lit(other))


def namespace(name: Column) -> Column:
    """The namespace of a name: what stands between its first two slashes, or the default one."""
    return F.when(name.rlike("^/[^/]+/"), F.regexp_extract(name, "^(/[^/]+/)", 1)).otherwise(F.lit("/BIC/"))


def local_name(name: Column) -> Column:
    return F.regexp_replace(name, "^/[^/]+/", "")


def generated_tables(name: Column, kind: Column) -> Column:
    """The tables that an object of a kind generates; one delivered with the system loses its leading 0."""
    delivered = (namespace(name) == "/BIC/") & local_name(name).rlike("^0.")
    space = F.when(delivered, "/BI0/").otherwise(namespace(name))
    local = F.when(delivered, F.substr(local_name(name), F.lit(2))).otherwise(local_name(name))
    of = lambda first, *ends: F.array(*[F.concat(space, F.lit(first), local, F.lit(e)) for e in ends])
    return F.when(kind == "adso", of("A", "1", "2", "3")).when(kind == "dso", of("A", "00", "40")).when(kind == "infocube", F.concat(of("F", ""), of("E", ""))).when(kind == "infoobject", of("P", "")).otherwise(F.array().cast("array<string>"))


def table_readings(table: Column) -> Column:
    """The readings of a generated table's name, likeliest first: (name, kind, role); none for other tables."""
    upper = F.upper(F.trim(table))
    body = F.regexp_extract(upper, "^/[^/]+/(.+)$", 1)
    first, rest = F.substring(body, 1, 1), F.substr(body, F.lit(2))
    cut = lambda n: F.left(rest, F.length(rest) - n)
    reading = lambda name, kind, role: F.struct(name.alias("name"), F.lit(kind).alias("kind"), (F.lit(role) if isinstance(role, str) else role).alias("role"))
    role = F.create_map(*[F.lit(x) for pair in STORE_ROLES.items() for x in pair])[F.right(rest, F.lit(1))]
    long = F.length(rest) > 2
    store = F.array(
        F.when(rest.endswith("00") & long, reading(cut(2), "dso", "active")), F.when(rest.endswith("40") & long, reading(cut(2), "dso", "inbound")), F.when(role.isNotNull(), reading(cut(1), "adso", role)),
        reading(rest, "adso", "active"), reading(rest, "dso", "active"),
    )
    one = F.when(first == "F", reading(rest, "infocube", "fact_f")).when(first == "E", reading(rest, "infocube", "fact_e")).when(first == "P", reading(rest, "infoobject", "master_attr")).when(
        first.isin(MASTER_CLASSES), reading(rest, "infoobject", "master_other"))
    found = F.filter(F.array_compact(F.when(first == "A", store).otherwise(F.array(one))), lambda x: x["name"] != "")
    space = namespace(upper)
    spelled = lambda x: F.when(space == "/BI0/", F.array(F.concat(F.lit("0"), x["name"]), x["name"])).when(space.isin(GENERATED), F.array(x["name"])).otherwise(F.array(F.concat(space, x["name"]), x["name"]))
    every = F.flatten(F.transform(found, lambda x: F.transform(spelled(x), lambda n: F.struct(n.alias("name"), x["kind"].alias("kind"), x["role"].alias("role")))))
    return F.when(upper.rlike("^/[^/]+/."), every)


def summable(aggrgen: Column, aggrexc: Column, ncumfl: Column) -> Column:
    """Whether a key figure's total is the sum of its values: no exception but SUM, no stock, neither minimum nor maximum."""
    exception, stock, general = (F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in (aggrexc, ncumfl, aggrgen))
    return exception.isin("", "SUM") & (stock == "") & ~general.isin("MIN", "MAX")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY_WEIGHTS]), severity) - 1


def without_hosts(text: Column) -> Column:
    """Text without what looks like a host: a dotted name or address, with its port."""
    return F.regexp_replace(text, r"\b(?:\d{1,3}(?:\.\d{1,3}){3}|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)(?::\d+)?\b", "(host)")


def stale_lookup(lookup_rate: Column, consumer_rate: Column) -> Column:
    """Whether what is looked up is loaded less often than what reads it; unknown rates tell nothing."""
    return (lookup_rate > 0) & (consumer_rate > 0) & (lookup_rate < consumer_rate)

"""Facilities on the map: distances, neighbour groups, areas, eligibility of destinations, features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.geo import KM_RADIUS, coordinate, distance_km, distance_m
from slotwise.session import cut

#: A table of places is a registry: broadcast only below this many rows.
REGISTRY_ROWS = 10_000


def small(df: DataFrame, rows: int = REGISTRY_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def name_pairs(registry: DataFrame) -> DataFrame:
    """(a, b): unordered pairs of the registry in its own order. ``registry`` has facility, pos.

    Every pair is the result wanted here; a registry is a small dimension, and a larger one is refused.
    """
    if registry.limit(REGISTRY_ROWS + 1).count() > REGISTRY_ROWS:
        raise ValueError(f"all pairs are made of at most {REGISTRY_ROWS} places; use within()")
    side = lambda name: registry.select(F.col("facility").alias(name), F.col("pos").alias(f"{name}_pos"))
    return side("a").join(F.broadcast(side("b")), F.col("a_pos") < F.col("b_pos")).select("a", "b")


def pairs(registry: DataFrame) -> DataFrame:
    """``name_pairs`` with their distance ``km``. ``registry`` has latitude and longitude too."""
    at = lambda name: F.broadcast(registry.select(F.col("facility").alias(name), F.col("latitude").alias(f"{name}_latitude"), F.col("longitude").alias(f"{name}_longitude")))
    km = distance_km(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude"))
    return name_pairs(registry).join(at("a"), "a").join(at("b"), "b").select("a", "b", km.alias("km"))


def within(registry: DataFrame, km: float) -> DataFrame:
    """(a, b, km) of the pairs at most ``km`` apart, by an equi-join over grid cells.

    Bands of latitude are ``km`` high. Within a band, cells of longitude are as wide as ``km`` at its edge nearer to a
    pole; a place looks into the cells around it of its own and both neighbouring bands.
    """
    height = math.degrees(km / KM_RADIUS)
    band = lambda lat: F.floor((lat + 90) / height).cast("bigint")
    # The edge nearest to a pole of the band and of both its neighbours, so that cells of all three agree in width.
    edge = lambda b: F.least(F.lit(90.0), F.greatest(F.abs((b - 1) * height - 90), F.abs((b + 2) * height - 90)))
    width = lambda b: F.least(F.lit(360.0), F.lit(height) / F.greatest(F.cos(F.radians(edge(b))), F.lit(1e-9)))
    n_cells = lambda b: F.greatest(F.floor(360 / width(b)), F.lit(1)).cast("bigint")
    cell = lambda lon, b: F.pmod(F.floor((lon + 180) / 360 * n_cells(b)), n_cells(b)).cast("bigint")
    rows = registry.select("facility", "pos", "latitude", "longitude").withColumn("band", band(F.col("latitude")))
    near = F.array_distinct(F.array(*[F.pmod(cell(F.col("longitude"), F.col("band")) + k, n_cells(F.col("band"))) for k in (-1, 0, 1)]))
    left = rows.select(*[F.col(c).alias(f"a_{c}") for c in ("facility", "pos", "latitude", "longitude")], F.col("band"), F.explode(near).alias("cell"))
    right = rows.select(*[F.col(c).alias(f"b_{c}") for c in ("facility", "pos", "latitude", "longitude")], F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = right.withColumn("cell", cell(F.col("b_longitude"), F.col("band")))
    met = left.join(right, ["band", "cell"]).where("a_pos < b_pos")
    far = distance_km(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude"))
    return met.select(F.col("a_facility").alias("a"), F.col("b_facility").alias("b"), far.alias("km")).where(F.col("km") <= km)


def distance_band(km: Column, near: float, far: float) -> Column:
    return F.when(km <= near, "neighbor").when(km <= far, "regional").otherwise("distant")


def neighbour_groups(registry: DataFrame, km: float) -> DataFrame:
    """(facility, group): components of the places within ``km`` of each other; the group is its lowest name.

    Labels travel by pointer jumping: each round takes the lowest label among the neighbours, then that
    label's own label, so that a chain of places takes a logarithmic number of rounds.
    """
    near = within(registry, km).select("a", "b")
    edges = cut(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = registry.select("facility", F.col("facility").alias("group"))
    while True:
        lower = edges.join(labels.withColumnRenamed("facility", "b"), "b").groupBy(F.col("a").alias("facility")).agg(F.min("group").alias("near"))
        lowered = labels.join(lower, "facility", "left").select("facility", F.least("group", F.coalesce("near", "group")).alias("group"), F.col("group").alias("old"))
        jumps = lowered.select(F.col("facility").alias("group"), F.col("group").alias("next"))
        after = cut(lowered.join(jumps, "group").select("facility", F.least("group", "next").alias("group"), "old"))
        labels = after.select("facility", "group")
        if after.where("old <> group").isEmpty():
            return labels


# Fixed value: the label of the area of all places.
ALL_PLACES = "All hospitals"


def areas(registry: DataFrame, groups: DataFrame, minimum: int = 3, *, all_label: str = ALL_PLACES, known: dict[str, str] | None = None) -> DataFrame:
    """(place, key, kind, label, members, facilities): all places, neighbour groups of at least ``minimum``, and every region.

    Groups stand after all, larger first, of equals the one whose first member comes first; regions in the order of
    their first member. Members keep the registry's order. ``registry`` has facility, pos, region, and name where
    labels of groups are to show another name than the facility's; a group with a member in ``known`` has the label given there.
    """
    kinds = F.array(
        F.struct(F.lit(0).alias("rank"), F.lit("all").alias("kind"), F.lit("all").alias("area")),
        F.struct(F.lit(1).alias("rank"), F.lit("near").alias("kind"), F.col("group").alias("area")),
        F.when(F.coalesce(F.col("region"), F.lit("")) != "", F.struct(F.lit(2).alias("rank"), F.lit("region").alias("kind"), F.col("region").alias("area"))),
    )
    shown = F.col("name" if "name" in registry.columns else "facility").alias("shown")
    rows = registry.join(groups, "facility").select("facility", "pos", shown, F.explode(F.array_compact(kinds)).alias("x"))
    found = rows.groupBy("x.rank", "x.kind", "x.area").agg(F.count(F.lit(1)).alias("members"), F.min("pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", "facility", "shown"))).alias("list"))
    found = found.where((F.col("kind") != "near") | (F.col("members") >= minimum))
    names = F.transform("list", lambda x: x["facility"])
    slug = lambda c: F.regexp_replace(F.lower(c), " ", "-")
    key = F.when(F.col("kind") == "all", "all").when(F.col("kind") == "near", F.concat(F.lit("near-"), names[0])).otherwise(F.concat(F.lit("region-"), slug(F.col("area"))))
    joined = F.coalesce(*[F.when(F.array_contains(names, who), text) for who, text in (known or {}).items()], F.array_join(F.transform("list", lambda x: x["shown"]), " / "))
    label = F.when(F.col("kind") == "all", all_label).when(F.col("kind") == "near", joined).otherwise(F.col("area"))
    # One row an area: the table to number is as small as the registry's groups.
    order = Window.orderBy("rank", F.when(F.col("kind") == "near", -F.col("members")), "first")
    return found.select((F.row_number().over(order) - 1).alias("place"), key.alias("key"), "kind", label.alias("label"), "members", F.array_join(names, ",").alias("facilities"))


def area_members(areas: DataFrame, registry: DataFrame) -> DataFrame:
    """(area, facility, pos) of every member of every area."""
    named = areas.select(F.col("key").alias("area"), F.explode(F.split("facilities", ",")).alias("facility"))
    return named.join(small(registry.select("facility", "pos")), "facility")


def areas_problem(areas: DataFrame, registry: DataFrame) -> str | None:
    """Why a table of areas is not fit for use, or None: the first has all places, keys differ, members are known and distinct."""
    rows = areas.select("place", "key", F.split("facilities", ",").alias("f"))
    first = rows.where("place = 0").select("key", F.size("f").alias("n")).first()
    if first is None or first.key != "all" or first.n != registry.count():
        return "the first area does not hold all places"
    n, keys, repeated = rows.agg(F.count(F.lit(1)), F.count_distinct("key"), F.count_if(F.size("f") != F.size(F.array_distinct("f")))).first()
    if n != keys or repeated:
        return "keys or members repeat"
    if not rows.select(F.explode("f").alias("facility")).join(registry, "facility", "left_anti").isEmpty():
        return "a member is not in the registry"
    return None


# Why a place is no destination, in the order in which the rules are asked.
REFUSALS = {
    "not_collected": "No published wait time · map only",
    "age_group": "Choose an age group",
    "inactive": "Active emergency service unverified",
    "service": "Emergency service applicability unverified",
    "age": "Age applicability unverified or unsuitable",
    "unverified": "Destination verification missing",
    "expired": "Destination verification expired",
    "entrance_evidence": "Emergency entrance evidence incomplete",
    "entrance_far": "Emergency entrance too far from campus",
    "no_arrival": "Arrival location unavailable",
}
# How an entrance may have been found, its greatest distance from the campus in metres, and days that a verification holds.
METHODS, FARTHEST, HOLDS = ("official_map", "site_visit", "aerial_imagery"), 1000, 90
AGE_GROUPS = ("adult", "child")


def usable(point: Column) -> Column:
    """Whether a point has coordinates within their limits, a label and an https source."""
    evidence = (point["label"] != "") & point["source_url"].startswith("https://")
    return F.coalesce(point.isNotNull() & coordinate(point["latitude"], 90) & coordinate(point["longitude"], 180) & evidence, F.lit(False))


def refusal(age_group: str, today: Column) -> Column:
    """Why a registry row is no destination for an age group: the first of ``REFUSALS`` that holds, or null."""
    entrance, campus = F.col("emergency_entrance"), F.col("campus_point")
    says = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    known = lambda c: F.coalesce(c, F.lit(False))
    verified, reviewed = F.col("travel_verified_on").try_cast("date"), entrance["reviewed_on"].try_cast("date")
    found = usable(entrance) & known(entrance["method"].isin(*METHODS)) & known(reviewed <= today)
    apart = distance_m(entrance["latitude"], entrance["longitude"], campus["latitude"], campus["longitude"])
    holds = {
        "not_collected": ~F.col("collection_enabled"),
        "age_group": F.lit(age_group not in AGE_GROUPS),
        "inactive": ~F.col("active_status").eqNullSafe("active"),
        "service": ~says("service_applicability", "general_emergency"),
        "age": ~says("age_applicability", age_group),
        "unverified": verified.isNull(),
        "expired": ~F.datediff(today, verified).between(0, HOLDS),
        "entrance_evidence": entrance.isNotNull() & ~found,
        "entrance_far": entrance.isNotNull() & usable(campus) & (apart > FARTHEST),
        "no_arrival": entrance.isNull() & ~usable(campus),
    }
    return F.coalesce(*[F.when(holds[rule], reason) for rule, reason in REFUSALS.items()])


def arrival_point() -> Column:
    """(kind, latitude, longitude) of where to arrive: the entrance, else a usable campus, else null."""
    at = lambda kind, column: F.struct(F.lit(kind).alias("kind"), F.col(f"{column}.latitude").alias("latitude"), F.col(f"{column}.longitude").alias("longitude"))
    return F.when(F.col("emergency_entrance").isNotNull(), at("entrance", "emergency_entrance")).when(usable(F.col("campus_point")), at("campus", "campus_point"))


def candidates(context: DataFrame, age_group: str, most: int = 20) -> DataFrame:
    """Destinations of a published context without a reason against them; fails unless they are 1 to ``most`` distinct slugs."""
    kept = context.where(F.col("eligibility")[age_group].isNull()).select("slug")
    n, distinct = kept.agg(F.count(F.lit(1)), F.count_distinct("slug")).first()
    if not 1 <= n <= most or n != distinct:
        raise ValueError("a context needs 1 to 20 distinct destinations")
    return kept


def features(registry: DataFrame) -> DataFrame:
    """GeoJSON features, one row for each campus point and entrance."""
    points = F.array(F.struct(F.lit("campus").alias("kind"), F.col("campus_point.latitude").alias("lat"), F.col("campus_point.longitude").alias("lon")), F.struct(F.lit("entrance").alias("kind"), F.col("emergency_entrance.latitude").alias("lat"), F.col("emergency_entrance.longitude").alias("lon")))
    rows = registry.select("slug", F.explode(points).alias("p")).where("p.lat IS NOT NULL AND p.lon IS NOT NULL")
    geometry = F.struct(F.lit("Point").alias("type"), F.array("p.lon", "p.lat").alias("coordinates"))
    return rows.select("slug", F.col("p.kind").alias("kind"), F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("slug", F.col("p.kind").alias("kind")).alias("properties"))).alias("feature"))


def feature_collection(registry: DataFrame) -> DataFrame:
    """One row: the GeoJSON FeatureCollection of a registry, a small dimension, in its order."""
    points = features(registry).join(registry.select("slug", "pos"), "slug")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "kind", "feature")))
    return points.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(ordered, lambda x: x["feature"]), ","), F.lit("]}")).alias("collection"))


def lookup(registry: DataFrame, slug: str) -> DataFrame:
    """The one row of a slug; an unknown one is an error."""
    found = registry.where(F.col("slug") == slug)
    if found.isEmpty():
        raise ValueError(f"no facility {slug}")
    return found


def set_entrance(registry: DataFrame, slug: str, entrance: dict | None) -> DataFrame:
    """``registry`` with another entrance of one facility, or with none."""
    lookup(registry, slug)
    kind = registry.schema["emergency_entrance"].dataType
    value = F.lit(None).cast(kind) if entrance is None else F.struct(*[F.lit(entrance.get(f.name)).cast(f.dataType).alias(f.name) for f in kind.fields]).cast(kind)
    return registry.withColumn("emergency_entrance", F.when(F.col("slug") == slug, value).otherwise(F.col("emergency_entrance")))


def review_rows(registry: DataFrame) -> DataFrame:
    """What a reviewer of entrances sees: every facility with its entrance, how and when it was found, and its distance from the campus."""
    e, c = F.col("emergency_entrance"), F.col("campus_point")
    far = distance_m(e["latitude"], e["longitude"], c["latitude"], c["longitude"])
    return registry.select("slug", "pos", e["latitude"].alias("latitude"), e["longitude"].alias("longitude"), e["method"].alias("method"), e["reviewed_on"].alias("reviewed_on"), far.alias("meters"))


#: The keys of an origin, all of which it must have and no others.
ORIGIN_KEYS = ("latitude", "longitude")


def origin_problem(origin: Column) -> Column:
    """Why JSON text is no origin, or null: it must be an object of exactly a latitude and a longitude within their limits."""
    keys = F.array_sort(F.json_object_keys(origin))
    number = lambda c: F.when(F.get_json_object(origin, f"$.{c}").rlike(r"^-?[0-9]") & ~origin.rlike(rf'"{c}"\s*:\s*"'), F.get_json_object(origin, f"$.{c}").try_cast("double"))
    bad = ~coordinate(number("latitude"), 90) | ~coordinate(number("longitude"), 180)
    return F.when(~F.coalesce(keys == F.array(*[F.lit(k) for k in ORIGIN_KEYS]), F.lit(False)), "keys").when(bad, "coordinates")


def compare_travel(routes: DataFrame, readings: DataFrame, screens: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Route, live reading and movement of each destination, ranked by drive; the closest only if every route is known.

    ``routes`` has origin, slug, status, seconds.
    """
    horizon = F.get(F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: h >= F.col("drive")), F.lit(0))
    rows = routes.withColumn("drive", F.when(F.col("status") == "ok", F.col("seconds") / 60)).withColumn("horizon_minutes", horizon)
    rows = rows.join(readings.select(F.col("facility").alias("slug"), F.col("value").alias("wait")), "slug", "left").join(screens.select(F.col("facility").alias("slug"), "horizon_minutes", "p90"), ["slug", "horizon_minutes"], "left")
    best = routes.groupBy("origin").agg(F.bool_and(F.col("status") == "ok").alias("complete"), F.min_by("slug", F.struct("seconds", "slug")).alias("nearest"))
    return rows.join(best, "origin").select("origin", "slug", "drive", "wait", (F.col("drive") + F.col("wait")).alias("total"), "horizon_minutes", "p90", (F.col("complete") & (F.col("slug") == F.col("nearest"))).alias("closest"))


#: What a travel comparison can be ordered by.
SORT_KEYS = ("drive", "wait", "total")


def ranked(rows: DataFrame, by: str = "drive") -> DataFrame:
    """The rows by drive, wait or their total, what is missing last and ties by drive; by drive if ``by`` is none of these."""
    return rows.orderBy(F.col(by if by in SORT_KEYS else "drive").asc_nulls_last(), F.col("drive").asc_nulls_last(), "slug")

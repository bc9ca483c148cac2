"""Derivations over the flat tables.

Each function returns a new DataFrame; "UPDATE table SET col = (subquery)"
of the source becomes a left join against a pre-aggregated key table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.operators.keys import pin_keys

# ---- fixed values -----------------------------------------------------------
# Role keywords: a credit role whose text contains any of these (ignoring
# case) makes the credited artist an edge of the release (D12). Must equal
# the source list, in its order.
ROLE_KEYWORDS = (
    "piano", "vocal", "perform", "bass", "viol", "drum", "keyboard", "guitar", "sax", "music",
    "written", "arrange", "lyric", "word", "compose", "song", "accordion", "chamberlin",
    "clarinet", "banjo", "band", "bongo", "bell", "bouzouki", "brass", "cello", "cavaquinho",
    "celest", "choir", "chorus", "handclap", "conduct", "conga", "percussion", "trumpet",
    "cornet", "djembe", "dobro", "organ", "electron", "horn", "fiddle", "flute", "recorder",
    "glocken", "gong", "guest", "vibra", "harmonium", "harmonica", "harp", "beatbox", "leader",
    "loop", "MC", "mellotron", "melod", "mixed", "oboe", "orchestra", "recorded", "remix", "saw",
    "score", "sitar", "strings", "synth", "tabla", "tambourine", "theremin", "timbales",
    "timpani", "whistle", "triangle", "trombone", "tuba", "vocoder", "voice", "phone", "woodwind",
)
# Roles of artist_masters rows that reference an artist to load.
MASTER_ROLES = ("Main", "Appearance", "TrackAppearance")
# -----------------------------------------------------------------------------


def artist_is_group(m) -> DataFrame:
    """``is_group`` = 1 when the artist has any member row, else 0."""
    groups = m.t("artist_members").select("id_artist").distinct().withColumn("__g", F.lit(1))
    return (m.t("artist").join(groups, "id_artist", "left")
            .withColumn("is_group", F.coalesce(F.col("__g"), F.lit(0)).cast("int")).drop("__g"))


def thumbnails(m) -> DataFrame:
    """Distinct (id, thumbnail) from aliases, members and groups."""
    return (m.t("artist_aliases").select(F.col("id_alias").alias("id_artist"), "url_thumbnail")
            .unionByName(m.t("artist_members").select(F.col("id_member").alias("id_artist"), "url_thumbnail"))
            .unionByName(m.t("artist_groups").select(F.col("id_group").alias("id_artist"), "url_thumbnail"))
            .distinct())


def artist_thumbnail(m, artists: DataFrame | None = None) -> DataFrame:
    """D3: artist ``url_thumbnail`` looked up in D2 (smallest when several)."""
    t = thumbnails(m).groupBy("id_artist").agg(F.min("url_thumbnail").alias("url_thumbnail"))
    a = artists if artists is not None else m.t("artist")
    return a.join(t, "id_artist", "left")


def item_counts(m) -> DataFrame:
    """Collected items per artist (items x release_artists rows)."""
    per_rel = m.t("collection_items").groupBy("id_release").agg(F.count(F.lit(1)).alias("__n"))
    return (m.t("release_artists").select("id_release", "id_artist").join(per_rel, "id_release")
            .groupBy("id_artist").agg(F.sum("__n").alias("qty_collection_items")))


def artist_item_counts(m, artists: DataFrame | None = None) -> DataFrame:
    """``qty_collection_items`` per artist; NULL (not 0) when none."""
    a = artists if artists is not None else m.t("artist")
    return a.join(item_counts(m), "id_artist", "left")


def derive_artist(m) -> DataFrame:
    """D13 (artist part): artist + is_group + url_thumbnail + qty_collection_items."""
    return artist_item_counts(m, artist_thumbnail(m, artist_is_group(m)))


# ---- roles ------------------------------------------------------------------

def role_dictionary(m, existing: DataFrame | None = None) -> DataFrame:
    """Distinct credit roles with ``as_edge`` 0; an existing dictionary wins."""
    roles = m.t("release_credits").select("role").distinct().withColumn("as_edge", F.lit(0))
    if existing is None:
        return roles
    return existing.select("role", "as_edge").unionByName(roles.join(existing.select("role"), "role", "left_anti"))


def role_pattern(keywords=ROLE_KEYWORDS) -> str:
    return "(?i)(" + "|".join(re.escape(k) for k in keywords) + ")"


def role_classification(m, keywords=ROLE_KEYWORDS, existing: DataFrame | None = None) -> DataFrame:
    """``as_edge`` = 1 when the role contains any keyword (case-insensitive).

    One regex alternation, evaluated JVM-side in the projection.
    """
    d = role_dictionary(m, existing)
    hit = F.col("role").rlike(role_pattern(keywords))
    return d.withColumn("as_edge", F.when(hit, F.lit(1)).otherwise(F.col("as_edge")).cast("int"))


# ---- relations ----------------------------------------------------------------

def rel_group_member(m) -> DataFrame:
    """Member -> group."""
    return m.t("artist_members").select(F.col("id_member").alias("id_artist_from"),
                                        F.col("id_artist").alias("id_artist_to"),
                                        F.lit("group_member").alias("relation_type"))


def rel_member_of_group(m) -> DataFrame:
    """Artist -> group it belongs to."""
    return m.t("artist_groups").select(F.col("id_artist").alias("id_artist_from"),
                                       F.col("id_group").alias("id_artist_to"),
                                       F.lit("group_member").alias("relation_type"))


def rel_alias(m) -> DataFrame:
    """Alias -> artist. A reciprocal pair is kept once, the row whose
    target is the larger id; one-sided aliases are always kept."""
    a = m.t("artist_aliases").select("id_artist", "id_alias")
    b = a.select(F.col("id_alias").alias("__b_alias"), F.col("id_artist").alias("__b_artist"))
    j = a.join(b, (a["id_artist"] == b["__b_alias"]) & (a["id_alias"] == b["__b_artist"]), "left")
    j = j.filter((F.col("id_artist") > F.col("__b_artist")) | F.col("__b_artist").isNull())
    return j.select(F.col("id_alias").alias("id_artist_from"), F.col("id_artist").alias("id_artist_to"),
                    F.lit("artist_alias").alias("relation_type"))


def rel_release_role(m, roles: DataFrame | None = None, artist_ids: DataFrame | None = None) -> DataFrame:
    """D5e: artist credited on its own release with an edge role.

    As in the source, both ends are the same artist (self-loops); the graph
    drops loops later. ``artist_ids`` restricts both inputs first. Without a
    role dictionary the keywords are matched on the credits themselves, so
    nothing is joined on the (hot) role text.
    """
    credits = m.t("release_credits").select("id_release", "id_artist", "role")
    if roles is None:
        credits = credits.filter(F.col("role").rlike(role_pattern()))
    else:
        credits = credits.join(roles.filter(F.col("as_edge") == 1).select("role"), "role", "left_semi")
    ra = m.t("release_artists").select("id_release", "id_artist")
    if artist_ids is not None:
        ra = ra.join(artist_ids.select("id_artist"), "id_artist", "left_semi")
        credits = credits.join(artist_ids.select("id_artist"), "id_artist", "left_semi")
    j = ra.join(credits, ["id_release", "id_artist"])
    return j.select(F.col("id_artist").alias("id_artist_from"), F.col("id_artist").alias("id_artist_to"),
                    F.lit("release_role").alias("relation_type"))


def co_appearance_hubs(m, known_only: bool = True, artist_ids: DataFrame | None = None) -> DataFrame:
    """D5d in hub form: (id_release, id_artist) for releases with at least two
    distinct artists.

    Co-appearance is "every two artists on one release". It is kept as this
    membership list — each release a hub — instead of the pair list, which
    is quadratic in the artists of a release. Graph jobs walk hubs directly;
    pairs are expanded only for a bounded set of artists (see
    ``co_appearance_pairs``).
    """
    known = lambda rows: rows.join(m.t("artist").select("id_artist"), "id_artist", "left_semi") if known_only else rows
    ra = m.t("release_artists").select("id_release", "id_artist")
    if artist_ids is not None:
        # only the hubs of the given artists (all their members): their ids are written, so their number is known
        mine = known(ra.join(artist_ids.select("id_artist"), "id_artist", "left_semi"))
        ra = ra.join(pin_keys(mine, "id_release"), "id_release", "left_semi")
    ra = known(ra.distinct())
    multi = ra.groupBy("id_release").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= 2)
    return ra.join(multi.select("id_release"), "id_release", "left_semi")


def co_appearance_pairs(hubs: DataFrame, artist_ids: DataFrame) -> DataFrame:
    """Co-appearance pairs touching ``artist_ids``, both directions.

    Work is linear in the hubs of those artists times their members; the
    id set is the bounded side (a page or a landing list).
    """
    ids = artist_ids.select(F.col("id_artist").alias("__s")).distinct()
    mine = hubs.join(ids, hubs["id_artist"] == ids["__s"]).select("id_release", "__s").distinct()
    pairs = (mine.join(hubs, "id_release")
             .filter(F.col("id_artist") != F.col("__s"))
             .select(F.col("__s").alias("id_artist_from"), F.col("id_artist").alias("id_artist_to")))
    both = pairs.unionByName(pairs.select(F.col("id_artist_to").alias("id_artist_from"),
                                    F.col("id_artist_from").alias("id_artist_to")))
    return both.distinct().withColumn("relation_type", F.lit("co_appearance"))


def explicit_relations(m, roles: DataFrame | None = None, artist_ids: DataFrame | None = None) -> DataFrame:
    """Union of the four row-derived branches (a, b, c, e), without filters.

    ``artist_ids`` only narrows the release-role branch (its two ends are the
    same artist); callers still filter the ends.
    """
    return (rel_group_member(m).unionByName(rel_member_of_group(m)).unionByName(rel_alias(m))
            .unionByName(rel_release_role(m, roles, artist_ids)))


def known_both_ends(m, rel: DataFrame) -> DataFrame:
    ids = m.t("artist").select("id_artist")
    return (rel.join(ids.withColumnRenamed("id_artist", "id_artist_from"), "id_artist_from", "left_semi")
            .join(ids.withColumnRenamed("id_artist", "id_artist_to"), "id_artist_to", "left_semi"))


def artist_relations(m, roles: DataFrame | None = None) -> DataFrame:
    """Distinct explicit relations whose both ends are known artists.

    Co-appearance lives in ``co_appearance_hubs`` (hub form), see there.
    """
    return known_both_ends(m, explicit_relations(m, roles)).distinct().select(
        "id_artist_from", "id_artist_to", "relation_type")


def stored_or_built(m, name: str, build):
    """A derived table as the derive step leaves it: stored once per
    application when the handle can store (``Model``), else built lazily."""
    return m.stored(name, build) if hasattr(m, "stored") else build()


def derived_relations(m) -> DataFrame:
    """Explicit relations (unfiltered), as stored by the derive step."""
    return stored_or_built(m, "derived_explicit_relations", lambda: explicit_relations(m))


def derived_hubs(m) -> DataFrame:
    """Known-artist co-appearance hubs, as stored by the derive step."""
    return stored_or_built(m, "derived_co_appearance_hubs", lambda: co_appearance_hubs(m))


# ---- frontier bookkeeping ------------------------------------------------------

def referenced_artist_ids(m) -> DataFrame:
    """Every artist id referenced by a loaded table."""
    masters = m.t("artist_masters").filter(F.col("role").isin(*MASTER_ROLES)).select("id_artist")
    return (masters
            .unionByName(m.t("artist_aliases").select(F.col("id_alias").alias("id_artist")))
            .unionByName(m.t("artist_members").select(F.col("id_member").alias("id_artist")))
            .unionByName(m.t("artist_groups").select(F.col("id_group").alias("id_artist")))
            .unionByName(m.t("release_artists").select("id_artist"))
            .distinct())


def artists_not_added(m, ignore: DataFrame | None = None, attempts: DataFrame | None = None,
                      max_attempts: int = 1) -> DataFrame:
    """Referenced artists not loaded, not ignored, not tried too often.

    ``NOT IN`` becomes null-filtered ``left_anti`` joins.
    """
    ignore = ignore if ignore is not None else m.t("artist_ignore")
    attempts = attempts if attempts is not None else m.t("artist_write_attempts")
    ids = referenced_artist_ids(m).filter(F.col("id_artist").isNotNull())
    tried = attempts.filter(F.col("qty_attempts") > max_attempts).select("id_artist")
    for other in (m.t("artist").select("id_artist"), ignore.select("id_artist"), tried):
        ids = ids.join(other.filter(F.col("id_artist").isNotNull()), "id_artist", "left_anti")
    return ids


def artists_not_added_count(m, **kw) -> DataFrame:
    """D9."""
    return artists_not_added(m, **kw).agg(F.count(F.lit(1)).alias("qty_artists_not_added"))


def write_attempts_merge(ledger: DataFrame, attempted_ids: DataFrame) -> DataFrame:
    """Add one attempt per id, then total per id."""
    new = attempted_ids.select("id_artist").withColumn("qty_attempts", F.lit(1).cast("bigint"))
    return (ledger.select("id_artist", F.col("qty_attempts").cast("bigint")).unionByName(new)
            .groupBy("id_artist").agg(F.sum("qty_attempts").alias("qty_attempts")))

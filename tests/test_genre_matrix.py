"""Q26 against a plain version, and what it shuffles."""

import random
from collections import defaultdict

from crateflow.operators import catalog as C
from crateflow.sources.bindings import TableSet


def _tables(spark, items, artists, genres, styles):
    return TableSet(collection_items=spark.createDataFrame([(i,) for i in items], "id_release bigint"),
                    release_artists=spark.createDataFrame(artists, "id_release bigint, id_artist bigint"),
                    release_genres=spark.createDataFrame(genres, "id_release bigint, name_genre string"),
                    release_styles=spark.createDataFrame(styles, "id_release bigint, name_style string"))


def _rows(seed=3):
    rnd = random.Random(seed)
    pick = lambda n, values: [(rnd.choice([None, *range(40)]), rnd.choice(values)) for _ in range(n)]
    items = [rnd.choice([None, *range(45)]) for _ in range(40)]  # some twice, some without artists
    return items, pick(90, [None, 1, 2, 3, 4, 5]), pick(60, [None, "Rock", "Jazz"]), pick(60, [None, "Punk", "Swing", "Dub"])


def _plain(items, artists, genres, styles):
    of = lambda pairs, i: {v for k, v in pairs if k == i}
    releases, people = defaultdict(set), defaultdict(set)
    for i in set(items) - {None}:
        for g in of(genres, i) or {None}:
            for s in of(styles, i) or {None}:
                if of(artists, i):
                    releases[g, s].add(i)
                    people[g, s] |= of(artists, i)
    return {k: (len(releases[k]), len(people[k])) for k in releases}


def test_matrix_equals_plain_counts(spark):
    rows = _rows()
    got = C.genre_style_matrix(_tables(spark, *rows)).collect()
    assert {(r.name_genre, r.name_style): (r.qty_collection_items, r.qty_collected_artists) for r in got} == _plain(*rows)
    assert len(got) == len(_plain(*rows))
    assert C.genre_style_matrix(_tables(spark, [], *rows[1:])).collect() == []


def test_combinations_are_formed_after_the_shuffle(spark):
    """One exchange for each table, one to the artists, one of the counts; none holds genre, style and artist."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = C.genre_style_matrix(_tables(spark, *_rows()))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    sent = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert not any("id_artist" in x and "name_genre" in x for x in sent)
    assert sum("hashpartitioning(id_artist" in x for x in sent) == 1 and len(sent) <= 6
    assert not any("kind" in x for x in sent)

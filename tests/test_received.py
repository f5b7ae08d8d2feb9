"""What is shared with whom: against Python on odd rows, and no shuffle of the users of all shares."""

from collections import Counter

from casebraid.operators import workspace


def frames(spark, shares, members, tags, saved):
    return (
        spark.createDataFrame(shares, "share_id long, tag_id long, usuario_destino long, equipe_destino_id long, deletado_em int"),
        spark.createDataFrame(members, "equipe_id long, usuario long, deletado_em int"),
        spark.createDataFrame(tags, "tag_id long, nome string, deletado_em int"),
        spark.createDataFrame(saved, "tag_id long, deletado_em int"),
    )


def test_against_python(spark):
    shares = [(1, 1, 7, None, None), (2, 1, None, 5, None), (3, 2, 7, 5, None), (4, 3, 7, None, None), (5, 1, 8, None, 1), (6, 1, None, 9, None), (7, 1, None, None, None)]
    shares += [(8, 1, 7, None, None), (8, 2, None, 5, None), (8, 3, 4, 6, None), (9, None, 7, 5, None)]
    members = [(5, 7, None), (5, 8, None), (5, 8, None), (5, None, None), (5, 9, 1), (6, 7, None), (6, 1, None)]
    tags, saved = [(1, "a", None), (2, "b", None), (3, "c", 1)], [(1, None), (1, None), (1, 1), (3, None)]
    found = workspace.received(*frames(spark, shares, members, tags, saved)).collect()
    live = [r for r in shares if r[4] is None]
    team = {(e, u) for e, u, dead in members if dead is None}
    users = {(r[2], r[0]) for r in live if r[2] is not None} | {(u, r[0]) for r in live for e, u in team if e == r[3]}
    names = {t: n for t, n, dead in tags if dead is None}
    wanted = [(u, s, r[1], names[r[1]], r[3], sum(1 for t, dead in saved if t == r[1] and dead is None)) for u, s in users for r in live if r[0] == s and r[1] in names]
    assert Counter(tuple(r) for r in found) == Counter(wanted)


def test_users_of_shares_are_not_shuffled(spark):
    shares = [(i, i % 50, None, i % 2, None) for i in range(1000)]
    members = [(e, u, None) for e in range(2) for u in range(40)]
    inputs = frames(spark, shares, members, [(t, "t", None) for t in range(50)], [(t, None) for t in range(50)])
    store = spark.sparkContext._jsc.sc().statusStore()
    before = spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    assert workspace.received(*inputs).count() == 40_000
    written = 0
    for stage in range(before, spark.sparkContext._jsc.sc().dagScheduler().nextStageId()):
        try:
            written += store.lastStageAttempt(stage).shuffleWriteRecords()
        except Exception:  # noqa: BLE001, S112  a stage that was skipped
            continue
    assert 0 < written < 10_000

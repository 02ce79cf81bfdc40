"""The group state machine."""

from tideline.operators import membership as M


def test_rebalance_and_sync():
    g = M.Group()
    assert g.join(0, "a", ["range", "sticky"], 10_000, None) == 0 and (g.state, g.generation, g.leader) == ("CompletingRebalance", 1, "a")
    assert g.sync(1, "a", 1, {"a": "p0"}) == 0 and g.state == "Stable" and g.members["a"].assignment == "p0"
    assert g.join(2, "b", ["range"], 10_000, None) == 0 and g.state == "PreparingRebalance"
    assert g.heartbeat(3, "a", 1) == M.REBALANCING and g.join(4, "a", ["range"], 10_000, None) == 0
    assert (g.state, g.generation, g.leader) == ("CompletingRebalance", 2, "a")
    assert g.sync(5, "b", 2, {}) == 0 and g.state == "CompletingRebalance" and g.sync(6, "a", 2, {"a": "x"}) == 0
    assert g.state == "Stable" and g.members["b"].assignment is None
    assert g.sync(7, "a", 1, {}) == M.ILLEGAL_GENERATION and g.heartbeat(7, "zz", 2) == M.UNKNOWN_MEMBER
    assert g.join(8, "c", ["other"], 10_000, None) == M.INCONSISTENT_PROTOCOL and g.state == "Stable"


def test_sessions_and_deadlines():
    g = M.Group()
    g.join(0, "a", ["range"], 10_000, None)
    g.sync(1, "a", 1, {})
    g.pass_time(10_000)
    assert g.state == "Stable"
    g.pass_time(10_001)
    assert g.state == "Empty" and g.leader is None
    g.join(20_000, "a", ["range"], 10**9, None)
    g.join(20_001, "b", ["range"], 10**9, None)
    g.pass_time(20_001 + M.REBALANCE_MS - 1)
    assert g.state == "PreparingRebalance"
    g.pass_time(20_001 + M.REBALANCE_MS)
    assert list(g.members) == ["b"] and g.leader == "b" and g.state == "CompletingRebalance"


def test_static_member_returns_without_a_rebalance():
    g = M.Group()
    g.join(0, "a-1", ["range"], 10**6, "a")
    g.sync(1, "a-1", 1, {"a-1": "p"})
    assert g.join(2, "a-2", ["range"], 10**6, "a") == 0
    assert (g.state, g.generation, g.leader, g.members["a-2"].assignment) == ("Stable", 1, "a-2", "p") and "a-1" not in g.members
    assert g.join(3, "a-3", ["sticky"], 10**6, "a") == 0 and g.generation == 2


def test_instances_are_fenced_and_leave_by_name():
    g = M.Group()
    g.join(0, "a-1", ["range"], 10**6, "a")
    g.sync(1, "a-1", 1, {"a-1": "p"}, "a")
    assert g.heartbeat(2, "a-1", 1, "a") == 0 and g.heartbeat(2, "a-1", 1, "zz") == M.UNKNOWN_MEMBER
    g.join(3, "a-2", ["range"], 10**6, "a")
    assert g.heartbeat(4, "a-1", 1, "a") == M.FENCED_INSTANCE == g.sync(4, "a-1", 1, {}, "a") and g.heartbeat(4, "a-2", 1, "a") == 0
    assert g.leave_all(5, [("other", "a"), ("a-2", None), ("x", "nobody")]) == [0, M.UNKNOWN_MEMBER, M.UNKNOWN_MEMBER] and g.state == "Empty"


def test_replay(spark):
    data = [("g", 1, 0, "join", "a", None, ["r"], 10, 0, None), ("g", 2, 1, "sync", "a", None, None, None, 1, {"a": "x"}), ("g", 3, 5, "heartbeat", "a", None, None, None, 1, None), ("g", 4, 6, "leave", "a", None, None, None, 1, None), ("h", 1, 0, "leave", "q", None, None, None, 0, None)]
    out = M.replay(spark.createDataFrame(data, M.EVENT)).orderBy("grp", "seq").collect()
    assert [(r.error_code, r.state, r.current_generation, r.n_members) for r in out] == [(0, "CompletingRebalance", 1, 1), (0, "Stable", 1, 1), (0, "Stable", 1, 1), (0, "Empty", 1, 0), (M.UNKNOWN_MEMBER, "Empty", 0, 0)]

"""Registered queries over all events, against plain Python."""

import os
from collections import defaultdict

from tideline.operators import membership
from tideline.plans import registry, txn_queries  # noqa: F401
from tideline.sources import event_log

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_group_replay_takes_every_event(spark):
    by_group = defaultdict(list)
    for r in event_log.records(spark, FOLDER).select("event_id", "user_id", "ts_ms", "event_type").collect():
        by_group[f"g{r.user_id % 5}"].append(r)
    want = []
    for name, rows in by_group.items():
        group = membership.Group()
        for r in sorted(rows, key=lambda r: r.event_id):
            group.pass_time(r.ts_ms)
            member = str(r.user_id)
            static = f"s{r.user_id % 8}" if r.user_id % 4 == 0 else None
            if r.event_type == "error":
                code = group.leave(r.ts_ms, member, static)
            elif r.event_type == "view":
                code = group.heartbeat(r.ts_ms, member, 1, static)
            else:
                code = group.join(r.ts_ms, member, ["range"], 3_600_000, static)
            want.append((name, r.event_id, code, group.state, group.generation, group.leader, len(group.members)))
    got = registry.QUERIES["group_replay"](spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == sorted(want)

"""The life of a consumer group as a state machine over its events."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: Error codes of the public protocol; fixed values.
UNKNOWN_MEMBER, ILLEGAL_GENERATION, REBALANCING, INCONSISTENT_PROTOCOL, FENCED_INSTANCE = 25, 22, 27, 23, 82
SESSION_MS, REBALANCE_MS = 45_000, 300_000


@dataclass
class Member:
    protocols: list[str]
    timeout_ms: int
    seen_ms: int
    instance: str | None = None
    joined: bool = True
    assignment: str | None = None


@dataclass
class Group:
    """States: Empty, PreparingRebalance, CompletingRebalance, Stable.

    A join starts a rebalance; it completes when all known members have
    joined again, or at its deadline without those that haven't. Then the
    generation rises, the leader stays if it is there (else the first by
    name leads), and the leader's sync hands out assignments. A static member
    that comes back with the same protocols while the group is stable takes
    its predecessor's place without a rebalance. Members whose session times
    out leave, which starts a rebalance too.
    """

    state: str = "Empty"
    generation: int = 0
    leader: str | None = None
    deadline: int | None = None
    members: dict[str, Member] = field(default_factory=dict)

    def prepare(self, now: int) -> None:
        if self.state != "PreparingRebalance":
            for m in self.members.values():
                m.joined = False
            self.state, self.deadline = "PreparingRebalance", now + REBALANCE_MS

    def complete(self, now: int) -> None:
        """Ends a rebalance that waits for nobody, or whose time is over."""
        if self.state != "PreparingRebalance":
            return
        if not all(m.joined for m in self.members.values()):
            if now < self.deadline:
                return
            self.members = {k: m for k, m in self.members.items() if m.joined}
        if not self.members:
            self.state, self.leader, self.deadline = "Empty", None, None
            return
        self.generation += 1
        if self.leader not in self.members:
            self.leader = min(self.members)
        for m in self.members.values():
            m.assignment = None
        self.state, self.deadline = "CompletingRebalance", None

    def pass_time(self, now: int) -> None:
        gone = [k for k, m in self.members.items() if now - m.seen_ms >= m.timeout_ms]
        if gone and self.state != "PreparingRebalance":
            for k in gone:
                del self.members[k]
            if self.members:
                self.prepare(now)
            else:
                self.state, self.leader = "Empty", None
        self.complete(now)

    def join(self, now: int, name: str, protocols: list[str], timeout_ms: int, instance: str | None) -> int:
        others = [set(m.protocols) for k, m in self.members.items() if k != name and not (instance and m.instance == instance)]
        if not protocols or (others and not set(protocols).intersection(*others)):
            return INCONSISTENT_PROTOCOL
        before = next((k for k, m in self.members.items() if instance and m.instance == instance and k != name), None)
        if before is not None:
            old = self.members.pop(before)
            self.members[name] = Member(protocols, timeout_ms, now, instance, True, old.assignment)
            self.leader = name if self.leader == before else self.leader
            if self.state == "Stable" and old.protocols == protocols:
                return 0
        known = name in self.members
        self.prepare(now)
        if known:
            self.members[name].joined, self.members[name].protocols, self.members[name].seen_ms = True, protocols, now
        else:
            self.members[name] = Member(protocols, timeout_ms, now, instance)
        self.complete(now)
        return 0

    def holder(self, instance: str) -> str | None:
        """The member that has the instance id now."""
        return next((k for k, m in self.members.items() if m.instance == instance), None)

    def check(self, name: str, generation: int, instance: str | None = None) -> int:
        """An instance id must be known, and be the member's own: else another one has taken its place."""
        if instance:
            now = self.holder(instance)
            if now is None:
                return UNKNOWN_MEMBER
            if now != name:
                return FENCED_INSTANCE
        if name not in self.members:
            return UNKNOWN_MEMBER
        return ILLEGAL_GENERATION if generation != self.generation else 0

    def sync(self, now: int, name: str, generation: int, assignments: dict[str, str], instance: str | None = None) -> int:
        if code := self.check(name, generation, instance):
            return code
        self.members[name].seen_ms = now
        if self.state == "PreparingRebalance":
            return REBALANCING
        if self.state == "CompletingRebalance" and name == self.leader:
            for k, m in self.members.items():
                m.assignment = assignments.get(k)
            self.state = "Stable"
        return 0

    def heartbeat(self, now: int, name: str, generation: int, instance: str | None = None) -> int:
        if code := self.check(name, generation, instance):
            return code
        self.members[name].seen_ms = now
        return REBALANCING if self.state == "PreparingRebalance" else 0

    def leave(self, now: int, name: str, instance: str | None = None) -> int:
        """One member leaves; an instance id, where given, says which."""
        if instance:
            name = self.holder(instance)
        if name not in self.members:
            return UNKNOWN_MEMBER
        del self.members[name]
        if self.members:
            self.prepare(now)
            self.complete(now)
        else:
            self.state, self.leader = "Empty", None
        return 0

    def leave_all(self, now: int, leaving: list[tuple[str, str | None]]) -> list[int]:
        """A batch of (member, instance) leaves, each with its own error code."""
        return [self.leave(now, name, instance) for name, instance in leaving]

    def apply(self, e) -> int:
        now = int(e.ts_ms)
        self.pass_time(now)
        if e.kind == "join":
            return self.join(now, e.member_id, list(e.protocols if e.protocols is not None else []), int(e.timeout_ms or SESSION_MS), e.instance_id)
        if e.kind == "sync":
            return self.sync(now, e.member_id, int(e.generation), dict(e.assignments or {}), e.instance_id)
        if e.kind == "heartbeat":
            return self.heartbeat(now, e.member_id, int(e.generation), e.instance_id)
        return self.leave(now, e.member_id, e.instance_id)


EVENT = "grp string, seq long, ts_ms long, kind string, member_id string, instance_id string, protocols array<string>, timeout_ms long, generation int, assignments map<string,string>"


def replay(events: DataFrame) -> DataFrame:
    """grp, seq, error_code, state, current_generation, leader, n_members after each event (columns as in EVENT).

    Groups run side by side; a group's events, which are few, go in order of
    seq. Time passes with the events.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        group, out = Group(), []
        for e in rows.sort_values("seq").itertuples():
            code = group.apply(e)
            out.append((e.grp, e.seq, code, group.state, group.generation, group.leader, len(group.members)))
        return pd.DataFrame(out, columns=["grp", "seq", "error_code", "state", "current_generation", "leader", "n_members"])

    return events.groupBy("grp").applyInPandas(run, "grp string, seq long, error_code int, state string, current_generation int, leader string, n_members int")

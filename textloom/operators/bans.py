"""Clients banned for probing or for many missing pages, and let in again: one keyed state, several kinds of events.

Requests are (client, ms, seq, kind, path, status): kind is `request`, or `unban` by an administrator; seq orders events of
one time. A banned client's requests are blocked and not counted. A probing path bans at once. A request that ends in 404
counts, in a window that begins with a client's first one and anew when one comes more than its length later; from
`threshold` on it bans. A ban stays until it is removed, which leaves the count as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .folds import folded

WINDOW_MS, THRESHOLD = 600_000, 10
#: Paths that only probes ask for; (pattern, whether case counts).
PROBES = [
    (r"/\.env", True), (r"/\.git", True), (r"/\.npmrc", True), (r"/\.yarn", True), (r"/\.ssh", True), (r"/\.aws", True),
    (r"/\.docker", True), (r"/\.stripe", True), (r"/\.bash_history", True), (r"/\.netrc", True), (r"/\.htpasswd", True),
    (r"config", False), (r"^/api/", True), (r"^/backend/", True), (r"/wp-", True), (r"/phpmy", True),
]
PROBE = "|".join(p if case else f"(?i:{p})" for p, case in PROBES)
State = tuple[bool, int, int]
ADDS = "outcome string, reason string, banned boolean"


def is_probe(path: Column) -> Column:
    """Whether a path, as it is or with its percent signs decoded, is one of a probe (P9); + stays +."""
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.rlike(path, F.lit(PROBE)) | F.coalesce(F.rlike(decoded, F.lit(PROBE)), F.lit(False))


def start() -> State:
    return False, 0, 0


def step(state: State, kind: str, probe: bool, status: int | None, ms: int, window_ms: int = WINDOW_MS, threshold: int = THRESHOLD) -> tuple[State, tuple[str, str | None, bool]]:
    """(state, (outcome, reason, banned)) after an event."""
    banned, count, begin = state
    if kind == "unban":
        return (False, count, begin), ("removed" if banned else "not banned", None, False)
    if banned:
        return state, ("blocked", "ip_banned", True)
    if probe:
        return (True, count, begin), ("blocked", "probe_path", True)
    if status != 404:
        return state, ("served", None, False)
    count, begin = (1, ms) if count == 0 or ms - begin > window_ms else (count + 1, begin)
    over = count >= threshold
    return (over, count, begin), ("missing", "rate_limit_404" if over else None, over)


def decided(requests: DataFrame, window_ms: int = WINDOW_MS, threshold: int = THRESHOLD) -> DataFrame:
    """The requests with outcome (served, missing, blocked, removed, not banned), reason, and banned: whether the client is now."""

    def one(state: State, kind: str, probe: bool, status: int | None, ms: int) -> tuple[State, tuple]:
        return step(state, kind, probe, status, ms, window_ms, threshold)

    rows = requests.withColumn("_probe", F.coalesce(is_probe(F.col("path")), F.lit(False)))
    return folded(rows, ["client"], ["ms", "seq"], ["kind", "_probe", "status", "ms"], ADDS, start, one).drop("_probe")


def bans(decided: DataFrame) -> DataFrame:
    """client of all that are banned at the end (R7); count() is the ban count."""
    last = decided.groupBy("client").agg(F.max_by("banned", F.struct("ms", "seq")).alias("banned"))
    return last.where("banned").select("client")

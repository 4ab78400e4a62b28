"""Running sums of live sessions: every request updates a few counts and emits one row.

The state of a session is a row of sums, its distinct symbols (pages, categories and steps between them) with their
counts, and the requests of its later half as pairs of small numbers: the early half, which the growth
features compare with, takes them in one by one. Symbols lie in pages of a map state; a batch reads and writes
only the pages it touches. The sums are those that the batch features are made of.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REQUEST_COLUMNS = [
    "op", "order_1", "order_2", "timestamp", "path", "page_category", "user_agent", "status_code", "depth", "out_degree",
    "is_leaf", "hubs_out", "hubs_in",
]
FAMILIES = ("node", "cat", "trans", "cattrans")
_COUNTS = [
    "n", "backtracks", "self_loops", "depth_sum", "depth_n", "leaves", "out_degree_sum", "hop_sum", "far_jumps", "fast",
    "statuses", "errors", "agents", "agent_switches", "category_switches", "left_pages",
]
_REALS = ["delta_sum", "delta_std", "branching"]
_OF_FAMILY = {"plogp": "double", "early_plogp": "double", "p2": "double", "is_early": "bigint", "distinct": "bigint"}
SUMS_SCHEMA = ", ".join([
    "session_id string, visit int, prefix_len int, started double, timestamp double, path string, first_agent string",
    *(f"{c} bigint" for c in _COUNTS), *(f"{c} double" for c in _REALS),
    *(f"{family}_{name} {kind}" for family in FAMILIES for name, kind in _OF_FAMILY.items()),
])
_FIELDS = [field.strip().split(" ")[0] for field in SUMS_SCHEMA.split(",")]
_TEXTS = ["session_id", "path", "first_agent"]
_NUMBERS = [name for name in _FIELDS if name not in _TEXTS]
#: What the state operator gives out. Every session is an Arrow batch that costs by its columns, so all numbers travel
#: as one array; requests come in as one JSON text each for the same reason.
PACKED_SCHEMA = "session_id string, path string, first_agent string, sums array<double>"
_PACKED = Row(*_TEXTS, "sums")
#: Symbols of one page of the state, and requests of one page of the later half.
PAGE_SYMBOLS, PAGE_REQUESTS = 64, 128
LOW_LATENCY, FAR_JUMP, NO_PATH = 1.0, 3, 999


def clogc(count: int) -> float:
    return count * math.log2(count) if count else 0.0


def missing(value) -> bool:
    return value is None or value != value


def unpacked(packed: DataFrame) -> DataFrame:
    """The sums as columns of their own; counts below 2^53 are exact as doubles."""
    kinds = dict(field.strip().split(" ") for field in SUMS_SCHEMA.split(","))
    numbers = {name: F.col("sums")[i].cast(kinds[name]).alias(name) for i, name in enumerate(_NUMBERS)}
    return packed.select(*(numbers.get(name, F.col(name)) for name in _FIELDS))


def _place(request: dict) -> tuple:
    """Order of arrival, rows without one last."""
    first, second = float(request.get("order_1", "nan")), request.get("order_2")
    return missing(first), 0.0 if missing(first) else first, second is None, second or ""


class MemoryPages(dict):
    """Pages without a state store."""

    def read(self, name: str):
        return self.get(name)

    def write(self, name: str, content) -> None:
        if content is None:
            self.pop(name, None)
        else:
            self[name] = content


class StatePages:
    """Pages as JSON texts in a map state."""

    def __init__(self, state):
        self._state = state

    def read(self, name: str):
        return json.loads(self._state.getValue((name,))[0]) if self._state.containsKey((name,)) else None

    def write(self, name: str, content) -> None:
        if content is not None:
            self._state.updateValue((name,), (json.dumps(content, separators=(",", ":")),))
        elif self._state.containsKey((name,)):
            self._state.removeKey((name,))


class RunningSession:
    """Sums and symbols of one session; ``flush`` writes what changed since it was opened."""

    def __init__(self, pages, stored: dict | None, visit: int = 0):
        self._pages, self._touched = pages, set()
        # a short session carries its pages in the row of sums
        self._read = (stored or {}).pop("inline", {})
        self._inline = set(self._read)
        self.s = stored or {
            "visit": visit, "pages": 1, "symbols": 0, "ids": [0, 0], "early": 0, "m2": 0.0,
            **{c: 0 for c in _COUNTS}, "delta_sum": 0.0, "branching": 0.0,
            # count, distinct, sum of c log c, sum of c c; the same of the early half without squares
            **{family: [0, 0, 0.0, 0, 0, 0, 0.0] for family in FAMILIES},
        }

    # pages

    @property
    def stored_apart(self) -> bool:
        """Whether the map state may hold pages of the session."""
        return self.s["n"] > 0 and not self._inline

    def _page(self, name: str) -> dict | list:
        if name not in self._read:
            self._read[name] = self._pages.read(name)
        return self._read[name]

    def _symbol_page(self, key: str) -> str:
        pages = self.s["pages"]
        return "s0" if pages == 1 else f"s{zlib.crc32(key.encode()) % pages}"

    def _get(self, key: str):
        return (self._page(self._symbol_page(key)) or {}).get(key)

    def _set(self, key: str, value) -> None:
        name = self._symbol_page(key)
        page = self._page(name)
        if page is None:
            page = self._read[name] = {}
        if key not in page:
            self.s["symbols"] += 1
        page[key] = value
        self._touched.add(name)
        if self.s["symbols"] > PAGE_SYMBOLS * self.s["pages"]:
            self._double_pages()

    def _double_pages(self) -> None:
        """Deal all symbols to twice as many pages: constant work a symbol over a session's life."""
        names = [f"s{i}" for i in range(self.s["pages"])]
        held = [item for name in names for item in (self._page(name) or {}).items()]
        self.s["pages"] *= 2
        for i in range(self.s["pages"]):
            self._read[f"s{i}"] = {}
            self._touched.add(f"s{i}")
        for key, value in held:
            self._read[self._symbol_page(key)][key] = value

    def flush(self) -> dict:
        if self.s["pages"] == 1 and self.s["n"] <= 2 * PAGE_REQUESTS:
            self.s["inline"] = {name: page for name, page in self._read.items() if page is not None}
            return self.s
        for name in self._touched | self._inline:
            self._pages.write(name, self._read[name])
        self._touched.clear()
        self._inline.clear()
        return self.s

    # counts

    def _number(self, kind: int, name: str) -> int:
        key = f"{'pc'[kind]}={name}"
        number = self._get(key)
        if number is None:
            number = self.s["ids"][kind]
            self.s["ids"][kind] += 1
            self._set(key, number)
        return number

    def _count(self, family: str, symbol: str, early: bool = False) -> int:
        """Count a symbol once more; how often it had been counted."""
        key = f"{family[0]}{symbol}" if family in ("node", "cat") else f"{family}{symbol}"
        counts = self._get(key) or [0, 0]
        before = counts[early]
        counts[early] += 1
        sums, at = self.s[family], 4 if early else 0
        sums[at] += 1
        sums[at + 1] += before == 0
        sums[at + 2] += clogc(before + 1) - clogc(before)
        if not early:
            sums[3] += 2 * before + 1
        self._set(key, counts)
        return before

    def _branch(self, page: int, before: int) -> None:
        """A step left ``page`` to a page it had led to ``before`` times: renew its share of the branching sum."""
        choices, leaving, total, degree = self._get(f"b{page}")

        def share(choices, leaving, total):
            support = degree if degree >= 2 else choices
            return 0.0 if choices <= 1 else (math.log2(leaving) - total / leaving) / math.log2(support)

        old = share(choices, leaving, total)
        self.s["left_pages"] += leaving == 0
        choices, leaving, total = choices + (before == 0), leaving + 1, total + clogc(before + 1) - clogc(before)
        self.s["branching"] += share(choices, leaving, total) - old
        self._set(f"b{page}", [choices, leaving, total, degree])

    def _grow_early_half(self) -> None:
        """Take requests into the early half until it is half the session, two at least."""
        while self.s["early"] < min(self.s["n"], max(2, self.s["n"] // 2)):
            at = self.s["early"]
            name = f"q{at // PAGE_REQUESTS}"
            page, category = self._page(name)[at % PAGE_REQUESTS]
            self._count("node", str(page), True)
            self._count("cat", str(category), True)
            if at:
                last = self.s["early_last"]
                self._count("trans", f"{last[0]}>{page}", True)
                self._count("cattrans", f"{last[1]}>{category}", True)
            self.s["early_last"] = [page, category]
            self.s["early"] = at + 1
            if (at + 1) % PAGE_REQUESTS == 0:
                self._read[name] = None
                self._touched.add(name)

    def observe(self, time: float, path: str, category: str, agent, status, depth: int, degree: int, leaf: bool,
                hubs_out: dict | None = None, hubs_in: dict | None = None) -> None:
        s = self.s
        page, kind = self._number(0, path), self._number(1, category)
        if self._get(f"b{page}") is None:
            self._set(f"b{page}", [0, 0, 0.0, degree])
        waiting = f"q{s['n'] // PAGE_REQUESTS}"
        if self._page(waiting) is None:
            self._read[waiting] = []
        self._read[waiting].append([page, kind])
        self._touched.add(waiting)
        s["n"] += 1
        if depth >= 0:
            s["depth_sum"] += depth
            s["depth_n"] += 1
        s["leaves"] += leaf
        s["out_degree_sum"] += degree
        s["statuses"] += status is not None
        s["errors"] += status is not None and status >= 400
        self._count("node", str(page))
        self._count("cat", str(kind))
        if s["n"] == 1:
            s["started"], s["first_agent"], s["agent"] = time, agent, None
        else:
            last, last_kind = s["last"], s["last_kind"]
            delta = max(0.0, time - s["time"])
            steps = s["n"] - 1
            mean = s["delta_sum"] / (steps - 1) if steps > 1 else 0.0
            s["delta_sum"] += delta
            s["m2"] += (delta - mean) * (delta - s["delta_sum"] / steps)
            s["fast"] += delta <= LOW_LATENCY
            s["self_loops"] += page == last
            s["backtracks"] += s["n"] > 2 and page == s["before"]
            s["category_switches"] += kind != last_kind
            s["agent_switches"] += agent is not None and s["agent"] is not None and agent != s["agent"]
            hops = 0 if page == last else 1
            if hops and hubs_in is not None:
                reached = [d + hubs_in[hub] for hub, d in (s["hubs_out"] or {}).items() if hub in hubs_in]
                hops = min(reached, default=NO_PATH)
            s["hop_sum"] += hops
            s["far_jumps"] += hops >= FAR_JUMP
            self._branch(last, self._count("trans", f"{last}>{page}"))
            self._count("cattrans", f"{last_kind}>{kind}")
            s["before"] = last
        s["agents"] += agent is not None
        s["agent"] = s["agent"] if agent is None else agent
        s["time"], s["last"], s["last_kind"] = time, page, kind
        s["hubs_out"] = hubs_out
        self._grow_early_half()

    def row(self, session: str, path: str) -> tuple:
        s = self.s
        steps = s["n"] - 1
        out = [session, s["visit"], s["n"], s["started"], s["time"], path, s["first_agent"], *(int(s[c]) for c in _COUNTS),
               s["delta_sum"], math.sqrt(max(s["m2"], 0.0) / steps) if steps else None, s["branching"]]
        for family in FAMILIES:
            n, distinct, total, squares, early_n, early_distinct, early_total = s[family]
            out += [total / n - math.log2(n) if n else 0.0, early_total / early_n - math.log2(early_n) if early_n else 0.0,
                    squares / (n * n) if n else 0.0, early_distinct, distinct]
        return tuple(out)


class RunningSums(StatefulProcessor):
    """One row of sums for each request of a session; ``reset`` rows and timers forget it."""

    def __init__(self, expire_seconds: float | None = None):
        self.expire_seconds = expire_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", "content string")
        self.symbols = handle.getMapState("symbols", "page string", "content string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a session's requests of one micro-batch, as many as the trigger lets in
        arrived = sorted((json.loads(row.request) for row in rows), key=_place)
        kept = self.summary.get()
        stored = json.loads(kept[0]) if kept else None
        session = RunningSession(StatePages(self.symbols), stored)
        for request in arrived:
            # absent where it is null
            of = request.get
            if request["op"] == "reset":
                if session.stored_apart:
                    self.symbols.clear()
                timer, visit = session.s.get("timer"), session.s["visit"] + 1
                session = RunningSession(StatePages(self.symbols), None, visit)
                session.s["timer"] = timer
                continue
            session.observe(
                float(request["timestamp"]), of("path"), of("page_category"), of("user_agent"), of("status_code"),
                request["depth"], request["out_degree"], request["is_leaf"],
                json.loads(request["hubs_out"]) if of("hubs_out") else None, json.loads(request["hubs_in"]) if of("hubs_in") else None)
            name, visit, number, started, time, path, agent, *sums = session.row(key[0], of("path"))
            yield _PACKED(name, path, agent, [visit, number, started, time, *sums])
        # one timer a session: it looks at the last request when it fires
        if self.expire_seconds is not None and session.s["n"] and not session.s.get("timer"):
            self.handle.registerTimer(self._end(session.s))
            session.s["timer"] = True
        self.summary.update((json.dumps(session.flush(), separators=(",", ":")),))

    def _end(self, sums: dict) -> int:
        return int((sums["time"] + self.expire_seconds) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.summary.get()
        sums = json.loads(kept[0]) if kept else None
        if sums and sums["n"] and self._end(sums) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self._end(sums))
        else:
            self.summary.clear()
            self.symbols.clear()
        return iter([])

    def close(self) -> None:
        pass

"""What the operators must compute, written one row at a time for small feeds."""

import random
import re

WORDS = ("Start proc", "Killing", "Force stopping")
SHAPE = re.compile(r"(.{18}) *([0-9]+) *([0-9]+) *([VDIWEF]) *(.*?): (.*)\Z", re.S)


def parse(line):
    """Only for lines with a space between pid and tid, where the pattern is unambiguous."""
    m = SHAPE.match(line)
    if not m or not m[5].strip():
        return None
    number = lambda s: int(s) if int(s) < 2**63 else 0
    return m[1], m[4], m[5].strip(), number(m[2]), number(m[3]), m[6]


class Device:
    """The state of one device; `take` is one line."""

    def __init__(self):
        self.newest, self.seen, self.session, self.key = "", set(), 0, None
        self.records, self.lines = [], []

    def take(self, seq, line, package):
        fields = parse(line)
        if fields is None:
            return
        ts, level, tag, pid, tid, msg = fields
        if ts < self.newest or (ts == self.newest and line in self.seen):
            return
        if ts != self.newest:
            self.newest, self.seen = ts, set()
        self.seen.add(line)
        restart = (tag in ("ActivityManager", "ActivityTaskManager") and bool(package) and package in msg
                   and any(w in msg for w in WORDS))
        self.session += restart
        key = (self.session, level, tag, pid, tid, ts)
        if key == self.key:
            self.records[-1][-1] += "\n" + msg
        else:
            self.records.append([len(self.records) + 1, self.session, ts, level, tag, pid, tid, msg])
            self.key = key
        self.lines.append((seq, len(self.records), self.session))


def ingest(feed, package, changes=()):
    device = Device()
    changes = sorted(changes)
    for seq, line in sorted(feed):
        now = package
        for at, name in changes:
            if at <= seq:
                now = name
        device.take(seq, line, now)
    return device


def fold(rows, same):
    """Runs of neighbours that agree on ``same``: (first row, last row, count)."""
    runs = []
    for row in rows:
        if runs and all(runs[-1][1][c] == row[c] for c in same):
            runs[-1] = (runs[-1][0], row, runs[-1][2] + 1)
        else:
            runs.append((row, row, 1))
    return runs


def feed(seed, n, gap=1):
    """A random feed with late lines, copies, restarts, continuations and junk."""
    rng = random.Random(seed)
    out, clock, seq = [], 0, 0
    for _ in range(n):
        seq += rng.randint(1, gap)
        clock += rng.choice([0, 0, 0, 0, 0, 1])
        at = max(0, clock - rng.choice([0] * 8 + [1, 3]))
        ts = f"05-01 10:{at // 60:02d}:{at % 60:02d}.000"
        kind = rng.random()
        if kind < 0.05:
            line = rng.choice(["junk", "", "--------- beginning of main", ts + "  1  2 X T: m"])
        elif kind < 0.15:
            word = rng.choice([*WORDS, "Start", "start proc"])
            tag = rng.choice(["ActivityManager", "ActivityTaskManager", "Other"])
            line = f"{ts}  1  1 I {tag}: {word} {rng.choice(['com.a', 'com.b', 'com.a.b'])} x{rng.randint(0, 1)}"
        else:
            line = (f"{ts}  {rng.randint(1, 2)}  1 {rng.choice('EI')} {rng.choice(['T', 'T', 'U'])} "
                    f": m{rng.randint(0, 3)}")
        out.append((seq, line))
    return out

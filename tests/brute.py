"""Plain versions of the operators, one row at a time, to hold the results against."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections import defaultdict


def ms(text):
    if text is None:
        return None
    t = text.strip()
    if re.fullmatch(r"\d{1,17}", t):
        n = int(t)
        return n * 1000 if n <= 10**11 else n
    m = re.fullmatch(r"(\d{4})[-/](\d\d?)[-/](\d\d?)[T ](\d\d):(\d\d):(\d\d)(?:\.(\d{1,6}))?(?:(Z)|([+-])(\d\d):?(\d\d))?", t)
    if not m:
        return None
    try:
        x = dt.datetime(*map(int, m.groups()[:6]), int((m[7] or "0").ljust(6, "0")), dt.timezone.utc)
    except ValueError:
        return None
    off = (int(m[10]) * 60 + int(m[11])) * (1 if m[9] == "+" else -1) if m[9] else 0
    return (x - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(milliseconds=1) - off * 60000


def periods(rows):
    """(target, started, completed) texts -> set of (target, kind, start, end)."""
    by = defaultdict(list)
    for target, a, b in rows:
        s, e = ms(a), ms(b)
        if target is None or not target.strip() or s is None or e is None or e <= s or max(s, e) >= 4133980800000:
            continue
        by[re.sub(r"[\s_]", "-", target.strip().lower())].append((s, e))
    out = set()
    for target, spans in by.items():
        last = None
        merged = []
        for s, e in sorted(spans):
            if last is None or s > last:
                merged.append([s, e])
            merged[-1][1] = last = max(merged[-1][1], e)
        out |= {(target, "period", s, e) for s, e in merged} | {(target, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def norm_path(p):
    q = p.replace("\\", "/")
    out = []
    for x in q.split("/"):
        if x == ".." and out and out[-1] != "..":
            out.pop()
        elif x == ".." and q.startswith("/"):
            pass
        elif x not in ("", "."):
            out.append(x)
    return ("/" if q.startswith("/") else "") + "/".join(out)


def orphans(sessions, threads, files, deps):
    month = lambda s: "unknown" if s is None else (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s)).strftime("%Y-%m")
    made, stat = {}, defaultdict(dict)
    for r in sessions:
        if r["id"] is None:
            continue
        k, c, u = r["id"].strip().lower(), ms(r["created_at"]), ms(r["updated_at"])
        made.setdefault(k, None)
        if c is not None:
            made[k] = c if made[k] is None else min(made[k], c)
        if u is not None:
            gone = (r["status"] or "").strip().lower() == "deleted"
            stat[k][u] = stat[k].get(u, True) and gone
    out = set()
    for r in threads:
        k = (r["session_id"] or "").strip().lower()
        if not k:
            continue
        t = ms(r["created_at"])
        per = month(None if t is None else t / 1000)
        if k not in made:
            out.add(("threads", r["id"], "missing", per))
        elif t is not None:
            before = [u for u in stat[k] if u <= t]
            if made[k] is not None and t < made[k]:
                out.add(("threads", r["id"], "late", per))
            elif before and stat[k][max(before)]:
                out.add(("threads", r["id"], "deleted", per))
    ok = lambda x: None if x is None or x != x else x
    by = defaultdict(list)
    for r in files:
        by[norm_path(r["path"])].append((ok(r["indexed_at"]), ok(r["deleted_at"])))
    for r in deps:
        if (r["dep_type"] or "").strip().lower() == "system" or not (r["target_path"] or "").strip():
            continue
        k, t = norm_path(r["target_path"]), ok(r["recorded_at"])
        if t is not None and t > 1e11:
            t /= 1000
        key = str(r["dep_id"])
        if k not in by:
            out.add(("file_dependencies", key, "missing", month(t)))
        elif t is not None and not any((a is None or a <= t) and (b is None or b > t) for a, b in by[k]):
            late = all(a is not None and a > t for a, _ in by[k])
            out.add(("file_dependencies", key, "late" if late else "deleted", month(t)))
    return out


def read(text):
    try:
        x = json.loads(text)
        x = json.loads(x) if isinstance(x, str) else x
    except (TypeError, ValueError):
        return None
    return x if isinstance(x, dict) else None


def activities(events, names):
    """names: canonical field -> the paths that bear it, whatever the feed."""
    last = {}
    for r in events:
        p = read(r["payload_json"])
        if p is None:
            continue
        k = r["workflow_id"], r["version"]
        if k not in last or last[k][0] < r["ingest_id"]:
            last[k] = (r["ingest_id"], r["event_type"], p)

    def get(p, field):
        for path in names[field]:
            x = p
            for part in path.split("."):
                x = x.get(part) if isinstance(x, dict) else None
            if x is not None:
                return x[0] if isinstance(x, list) else x
        return None

    state = {}
    for (wf, version), (_, kind, p) in sorted(last.items()):
        key = (wf, get(p, "activity_id"))
        if not kind.startswith("activity") or key[1] is None:
            continue
        status, attempt = get(p, "status"), get(p, "attempt")
        attempt = None if attempt is None else int(re.match(r"[+-]?\d+", str(attempt)).group())
        if kind == "activity_scheduled":
            state[key] = (status, attempt, version)
        elif kind == "activity_cancelled":
            state.pop(key, None)
        elif key in state:
            s = state[key]
            state[key] = (s[0] if status is None else status, s[1] if attempt is None else attempt, version)
    return {(*k, *v) for k, v in state.items()}

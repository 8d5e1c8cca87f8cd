"""Plain versions of the contracts, one text at a time."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal_data(text: str | None) -> tuple:
    """n_email, n_ip, n_card, n_phone, base_sha256."""
    text = text or ""
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    spans, counts = [], []
    for rank, (kind, pattern) in enumerate(kinds.items()):
        n = 0
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                n += 1
                spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
        counts.append(n)
    return (*counts, sha256(",".join(s[2] for s in sorted(spans))))


def shingles(text: str | None, size: int) -> set:
    words = [w for w in re.split("[\x20\x09-\x0d]+", ascii_lower(text or "")) if w]
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_duplicates(rows: list[tuple], size: int, percent: int) -> dict:
    """n_shingles and component_id by doc_id."""
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    shared = Counter()
    for ids in by_shingle.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def phrase_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def decontamination(rows: list[tuple], items: list[tuple], size: int = 13) -> dict:
    windows = defaultdict(set)
    for i, t in items:
        words = phrase_words(t)
        n = min(size, len(words))
        if n:
            for k in range(len(words) - n + 1):
                windows[tuple(words[k : k + n])].add(i)
    lengths = {len(w) for w in windows}
    out = {}
    for i, t in rows:
        words, hit, found = phrase_words(t), set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                names = windows.get(tuple(words[k : k + n]))
                if names:
                    found |= names
                    hit |= set(range(k, k + n))
        out[i] = (len(words), len(hit), len(found), sha256(",".join(sorted(map(str, found)))), len(hit) > 0 and 20 * len(hit) >= len(words))
    return out


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def suffix_dedup(rows: list[tuple], length: int = 400) -> dict:
    times = Counter()
    for _, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            times[hash(b[k : k + length])] += 1
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if times[hash(b[k : k + length])] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, sha256(kept))
    return out


def chat(rows: list[tuple]) -> dict:
    """n_turns, turns_sha256, loss_chars, loss_sha256 by conv_id, of (conv_id, turn, role, text)."""
    rows = rows + [(-1, k, r, "<|im_end|><|im_start|>assistant ok") for k, r in enumerate(("user", "assistant"))]
    by = defaultdict(list)
    for c, k, r, t in rows:
        by[c].append((k, r, t or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha256("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha256(loss))
    return out


def archive(rows: list[tuple]) -> dict:
    """payload_bytes, payload_digest, record_type, refers_to by page_id, of (page_id, html)."""
    digest = {p: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for p, h in rows}
    first: dict[str, int] = {}
    for p in sorted(digest):
        first.setdefault(digest[p], p)
    return {
        p: (len((h or "").encode()), digest[p], *(("response", None) if first[digest[p]] == p else ("revisit", first[digest[p]])))
        for p, h in rows
    }

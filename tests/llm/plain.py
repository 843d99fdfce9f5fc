"""Plain one-process versions of the operators, for comparison."""

import hashlib
import re
import struct
from collections import defaultdict

import xxhash
from tokenizers import Tokenizer

from pulsegrid.llm.queries import VOCABULARY

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def fingerprint(text, k=3):
    words = BLANK.findall(lower(text))
    if not words:
        return 0
    parts = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance=2):
    """{row: (component's least fingerprint)} by comparing all pairs."""
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(v) for v in prints]


def near_dedup(rows, k=3, distance=2):
    """Rows (dicts with doc_id and text) of the least id of each component."""
    found = groups([fingerprint(r["text"], k) for r in rows], distance)
    least = {}
    for r, g in zip(rows, found):
        if g not in least or r["doc_id"] < least[g]["doc_id"]:
            least[g] = r
    return sorted(least.values(), key=lambda r: r["doc_id"])


def _hash_long(value, seed):
    h = xxhash.xxh64_intdigest(struct.pack("<q", value), seed & (1 << 64) - 1)
    return h - (1 << 64) if h >> 63 else h


def lines_of(text):
    return re.split(r"(?<=\n)|(?<=[.!?] )", text)


BLANKS = " \t\r\n\f\x0b"


def chunks(text, cut=8, least_lines=2, least_words=16, long=16, lone=50):
    """Lines of a text, and its chunks (start, end, their bare lines)."""
    lines = lines_of(text)
    bare = [x.rstrip(BLANKS) for x in lines]
    words = [sum(x.count(b) for b in BLANKS) + 1 for x in lines]
    hashes = []
    for line in bare:
        h = xxhash.xxh64_intdigest(line.encode(), 42)
        hashes.append(h - (1 << 64) if h >> 63 else h)
    starts = [0]
    for i in range(1, len(lines)):
        r = 42
        for h in hashes[max(0, i - 2):i]:
            r = _hash_long(h, r)
        if r % cut or words[i] >= long or words[i - 1] >= long:
            starts.append(i)
    out = set()
    for k, s in enumerate(starts):
        e = starts[k + 2] if k + 2 < len(starts) else len(lines)
        for e in {e, s + 1} if words[s] >= lone else {e}:
            if (e - s >= least_lines or words[s] >= lone) and sum(words[s:e]) >= least_words:
                out.add((s, e, tuple(bare[s:e])))
    return lines, sorted(out)


def line_dedup(rows):
    """Texts without the chunks that a row of lesser id (or an earlier place) has."""
    where = defaultdict(list)
    for n, r in enumerate(rows):
        for s, e, key in chunks(r["text"] or "")[1]:
            where[key].append((r["doc_id"], n, s, e))
    gone = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            first = min(p[0] for p in places)
            kept = {}
            for d, n, s, e in sorted(places):
                if d == first and kept.setdefault(n, s) == s:
                    continue
                gone[n].update(range(s, e))
    out = []
    for n, r in enumerate(rows):
        text = r["text"]
        if gone[n]:
            text = "".join(x for i, x in enumerate(lines_of(text)) if i not in gone[n])
        out.append({**r, "text": text, "gone": len(gone[n])})
    return out


def contamination(texts, items, window=10):
    """(words, hit word numbers, item ids) of each text."""
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall(lower(text))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows[tuple(words[i:i + window])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (key := tuple(words[i:i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key] - {None}
        out.append((len(words), hit, found))
    return out


def cut_out(text, hit):
    if not hit:
        return text
    places = [m.span() for m in WORD.finditer(lower(text))]
    out, at = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out.append(text[at:places[i][0]])
        at = places[i][1]
    return "".join(out) + text[at:]


TOKENIZER = Tokenizer.from_file(VOCABULARY)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digests(text):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
    return (len(ids), sha(",".join(map(str, ids))),
            sha(TOKENIZER.decode(ids, skip_special_tokens=False)))

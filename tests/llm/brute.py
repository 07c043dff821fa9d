"""What the operators must give, by comparing everything with everything."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(text, items, n):
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        own = words_of(body)
        for i in range(max(len(own) - n + 1, min(len(own), 1))):
            phrase = own[i:i + n]
            for at in range(len(words) - len(phrase) + 1):
                if words[at:at + len(phrase)] == phrase:
                    hit.update(range(at, at + len(phrase)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


def near_copies(texts, n, share):
    """(set size, component) by comparing all pairs."""
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    component = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * len(sets[i] | sets[j]):
                a, b = component[i], component[j]
                component = [min(a, b) if c in (a, b) else c for c in component]
    return [(len(s), c) for s, c in zip(sets, component)]


def cut(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
    return out


def cut_both(texts, length, words):
    """What stays of each text when repeated windows of ``length`` bytes and of ``words`` words go."""
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    seen = {}
    for t, own in zip(texts, places):
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
        for i in range(len(own) - words + 1):
            key = tuple(t[a:b] for a, b in own[i:i + words])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for t, own in zip(texts, places):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        for i in range(len(own) - words + 1):
            if seen[tuple(t[a:b] for a, b in own[i:i + words])] > 1:
                gone[own[i][0]:own[i + words - 1][1]] = True
        out.append((int(gone.sum()), bytes(b for b, g in zip(t, gone) if not g).decode(errors="ignore")))
    return out


def checked_packs(rows, library, texts_by_id, length):
    """Every sequence is gapless and no longer than allowed; every id of every document lies in one piece."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    assert set(by_doc) == set(texts_by_id)
    for doc, own in by_doc.items():
        ids = library(texts_by_id[doc]) + [1]
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == [sum(o["length"] for o in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids)
        for r in own:
            part = packed[4 * r["start"]:4 * (r["start"] + r["length"])]
            assert (r["ids_crc32"], r["doc_tokens"], bytes(r["ids"])) == (zlib.crc32(part), len(ids), part)
    return len(by_sequence)

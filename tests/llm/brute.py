"""Plain versions of the operators, for comparison."""

import bisect
import collections
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm import packing


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4)))


def components(rows, percent=85):
    """doc_id -> (set size, smallest doc_id reachable), by comparing texts that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    parent, where = {i: i for i in sets}, collections.defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = collections.Counter(j for g in s for j in where[g])
        for g in s:
            where[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def token_pieces(rows, size=4096):
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    out = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), size):
            out.append((i, k // size, k, len(ids[k : k + size]), zlib.crc32(np.array(ids[k : k + size], "<u4").tobytes())))
    return out


def best_fit_bins(lengths, size=4096):
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else size
        bisect.insort(rooms, room - n)
    return len(rooms)


TOKEN = re.compile(r"[^\W_]+")


def leaks(rows, items, window=20, share=0.8):
    """doc_id -> item ids that some alignment without gaps covers well enough, whatever the seeds."""
    out = collections.defaultdict(set)
    for i, text in rows:
        d = TOKEN.findall((text or "").lower())
        for item, t in items:
            b = TOKEN.findall((t or "").lower())
            w = min(window, len(b))
            for shift in range(-(len(b) - w), len(d) - w + 1) if b else ():
                low, high = max(0, -shift), min(len(b), len(d) - shift)
                same = [d[k + shift] == b[k] for k in range(low, high)]
                run = sum(same[:w])
                best = run
                for k in range(w, len(same)):
                    run += same[k] - same[k - w]
                    best = max(best, run)
                if best >= (share * w if w >= 8 else w):
                    out[i].add(item)
    return dict(out)

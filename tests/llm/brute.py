"""Plain, whole-table versions of the operators' contracts, to test against."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


@lru_cache(1)
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def bpe(doc_id, text):
    ids = ids_of(text)
    return (doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer().decode(ids, skip_special_tokens=False)))


def chat(turns):
    """turns: (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t is not None, t, r or "", x or ""))
    out = {}
    for c, said in by.items():
        said.sort()
        loss = "".join(x for _, _, r, x in said if r == "assistant")
        out[c] = (len(said), sha("".join(f"{r}\n{x}\n" for _, _, r, x in said)), len(loss), sha(loss))
    return out


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    keys = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(keys), set()
    for i, k in enumerate(keys):
        if count[k] > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, rep = len(words), len(covered)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, rep, n < 10 or 100 * rep > 20 * n)


def pack_check(rows, texts):
    """rows: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of documents with unique ids."""
    fill, parts = defaultdict(list), defaultdict(list)
    for d, start, length, crc, total, seq, offset in rows:
        ids = ids_of(texts[d]) + [2]
        assert total == len(ids) and length > 0
        raw = b"".join(i.to_bytes(4, "little") for i in ids[start:start + length])
        assert zlib.crc32(raw) == crc
        fill[seq].append((offset, length))
        parts[d].append((start, length))
    for pieces, of in ((fill, lambda s: 4096), (parts, lambda d: 1 << 60)):
        for key, xs in pieces.items():
            at = 0
            for a, n in sorted(xs):
                assert a == at
                at += n
            assert at <= of(key)
    assert {d: sum(n for _, n in xs) for d, xs in parts.items()} == {d: len(ids_of(t)) + 1 for d, t in texts.items()}
    assert sorted(fill) == list(range(len(fill)))
    assert all(sum(n for _, n in fill[s]) == 4096 for s in list(fill) if s != max(fill))


def exact(rows):
    groups = defaultdict(list)
    for d, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(d)
    out = []
    for text, ids in groups.items():
        least = min((d for d in ids if d is not None), default=None)
        for k, d in enumerate(sorted(ids, key=lambda d: (d is None, d))):
            out.append((d, least, len(ids), k == 0, sha(text)))
    return out


KEY = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in KEY.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def spans_text(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def substring_removed(rows, k=20):
    """(doc_id, n_words, n_removed, kept_sha256) of rows (doc_id, text); a null doc_id counts as the largest."""
    last = 1 << 63
    first, words = {}, []
    for d, text in rows:
        w = WORD.findall(text or "")
        words.append((d, w))
        for s in range(len(w) - k + 1):
            key = tuple(w[s:s + k])
            at = (last if d is None else d, s)
            if key not in first or at < first[key]:
                first[key] = at
    out = []
    for d, w in words:
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s:s + k])] < (last if d is None else d, s):
                gone.update(range(s, s + k))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = WORD.findall(lower_az(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def near(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs that share a shingle."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = defaultdict(list)
    first = {}
    for i, (_, s) in enumerate(sets):
        if s in first and s:
            parent[root(i)] = root(first[s])
            continue
        first[s] = i
        shared = Counter(j for x in s for j in where[x])
        for j, n in shared.items():
            if 100 * n >= 85 * (len(s) + len(sets[j][1]) - n):
                parent[root(i)] = root(j)
        for x in s:
            where[x].append(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = root(i)
        if d is not None and (r not in least or d < least[r]):
            least[r] = d
    return [(d, len(s), least.get(root(i))) for i, (d, s) in enumerate(sets)]


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc(rows):
    """(page_id, bytes, digest, record type, refers_to) of rows (page_id, html) with unique ids."""
    most = {}
    for p, html in rows:
        d = digest32((html or "").encode())
        most[d] = max(most.get(d, p), p)
    out = []
    for p, html in rows:
        raw = (html or "").encode()
        d = digest32(raw)
        out.append((p, len(raw), d, "response" if most[d] == p else "revisit", None if most[d] == p else most[d]))
    return out

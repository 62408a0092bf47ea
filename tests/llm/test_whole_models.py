"""Language and toxicity queries as wholes against plain programs, one word or one document at a time."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gridsift.llm import language_id, toxicity

FOLDER = "/root/testdata/sf0.001"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def letters(word):
    return "".join(c for c in word if c.isalpha()).lower()


def buckets(word):
    """Hash buckets of a word's n-grams, with its two ends; single characters are letters only."""
    framed, out = f"<{word}>", []
    for n in (1, 2, 3, 4):
        for i in range(len(framed) - n + 1):
            gram = framed[i : i + n]
            if n == 1 and i in (0, len(framed) - 1):
                continue
            h = int(language_id._FNV)
            for c in gram:
                h = ((h ^ ord(c)) * int(language_id._PRIME)) % 2**32
            out.append((h ^ (h >> 15)) % language_id.BUCKETS)
    return out


def script(c):
    return next((name for name, low, high in language_id.SCRIPTS if low <= ord(c) <= high), "other")


def languages_by_hand(rows):
    """doc_id -> (language, share of letters) for rows (doc_id, text, lang)."""
    grams, scripts = {}, {}
    for i, text, lang in rows:
        if text is None or lang is None or held_out(i):
            continue
        for word in map(letters, text.split()):
            if word:
                grams.setdefault(lang, Counter()).update(buckets(word))
                scripts.setdefault(lang, Counter()).update(set(map(script, word)))
    names = sorted(grams)
    log_p = {}
    for lang in names:
        total = sum(grams[lang].values()) + 0.5 * language_id.BUCKETS
        log_p[lang] = lambda b, own=grams[lang], total=total: float(np.float32(math.log((own[b] + 0.5) / total)))
    used = {lang: {s for s, n in own.items() if n >= language_id.MIN_SCRIPT_SHARE * sum(own.values())} for lang, own in scripts.items()}

    def word_scores(word):
        own = buckets(word)
        candidates = [bool(set(map(script, word)) & used[lang]) for lang in names]
        if not any(candidates):
            return [0.0] * len(names), 0
        raw = [sum(map(log_p[lang], own)) / math.sqrt(max(len(own), 1)) if c else -math.inf for lang, c in zip(names, candidates, strict=True)]
        return [s - max(raw) if c else -2 * language_id.SWITCH_PENALTY for s, c in zip(raw, candidates, strict=True)], len(word)

    out, known = {}, {}
    for i, text, _ in rows:
        words = [known.setdefault(w, word_scores(letters(w))) for w in (text or "").split()]
        held = [0] * len(names)
        if words:
            value, came = list(words[0][0]), []
            for scores, _ in words[1:]:
                top = value.index(max(value))
                stay = [v >= value[top] - language_id.SWITCH_PENALTY for v in value]
                came.append([k if s else top for k, s in enumerate(stay)])
                value = [(v if s else value[top] - language_id.SWITCH_PENALTY) + x for v, s, x in zip(value, stay, scores, strict=True)]
            label = value.index(max(value))
            for (_, n), back in zip(reversed(words), [*reversed(came), None], strict=True):
                held[label] += n
                label = back[label] if back else label
        total = sum(held)
        if not any(c.isalpha() for c in text or ""):
            out[i] = ("und", 0.0)
        else:
            out[i] = (names[held.index(max(held))], max(held) / total if total else 0.0)
    return out


def test_language_query_equals_a_plain_program(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()]
    want = languages_by_hand(rows)
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in language_id.query(spark, FOLDER).collect()}
    assert got.keys() == want.keys()
    off = [i for i in got if got[i][:2] != (held_out(i), want[i][0]) or got[i][2] != pytest.approx(want[i][1], abs=1e-9)]
    assert len(off) <= 1, off  # sums in another order may decide one close word otherwise


def clause_weights(words, lexicon):
    """Matches of one clause, by the rules in words: reported speech, negation within three words, targets before insults."""
    reported, left, aimed, out = False, 0, False, []
    for word in words:
        kind = lexicon(word)
        if kind == "report" and not reported:
            reported, kind = True, "other"
        if kind in ("insult", "threat") and reported:
            kind = "quoted"
        if kind == "negation":
            left, kind = toxicity.NEGATION_REACH, "other"
        elif left > 0 and kind in ("insult", "threat"):
            left, kind = left - 1, "negated"
        elif left > 0 and kind in ("other", "target", "quoted"):
            left -= 1
        if kind == "target":
            aimed, kind = True, "other"
        elif kind == "insult":
            kind = "aimed" if aimed else "plain"
        weight = {"aimed": 1.5, "negated": 0.5, "quoted": 0.5, "plain": 1.0, "threat": 1.0}.get(kind)
        if weight:
            out.append((kind, weight))
    return out


def toxicity_by_hand(docs, labels):
    """doc_id -> score; docs are (doc_id, text), labels doc_id -> 0 or 1 of the rows that are learned from."""
    terms = {}
    for i, text in docs:
        own = set()
        for word in map(letters, (text or "").split()):
            if len(word) >= 3:
                own |= {f"={word}"} | {word[:n] for n in range(4, 11) if n <= len(word)}
        terms[i] = own
    toxic, other = Counter(), Counter()
    for i, label in labels.items():
        (toxic if label else other).update(terms[i])
    allowed = {t: (n + 0.5) / (n + other[t] + 1.0) for t, n in toxic.items() if n >= toxicity.MIN_SUPPORT and n >= toxicity.MIN_PRECISION * (n + other[t])}
    wanted = {i: toxicity.COVERS for i, label in labels.items() if label}
    chosen, passed = [], set()
    while True:
        open_ = Counter(t for i, n in wanted.items() if n > 0 for t in terms[i] & allowed.keys() if t not in passed)
        best = max((t for t, n in open_.items() if n >= toxicity.MIN_SUPPORT), key=lambda t: (open_[t] * allowed[t], len(t), t), default=None)
        if best is None:
            break
        passed.add(best)
        if any(best.lstrip("=")[:n] in chosen for n in range(4, len(best) + 1)):
            continue
        chosen.append(best)
        for i in wanted:
            wanted[i] -= best in terms[i]
    fixed = {w: tag for tag, ws in toxicity._SEEDS.items() for w in ws.split()}

    def term(word):
        bare = letters(word)
        return f"={bare}" if f"={bare}" in chosen else min((t for t in chosen if t[0] != "=" and bare.startswith(t)), key=len, default=None)

    threats = {t for t in chosen if any(t.lstrip("=").startswith(s) for s in toxicity._STEMS)}
    held, after = Counter(), Counter()
    for i, text in docs:
        if labels.get(i):
            words = (text or "").split()
            ends = [bool(toxicity._CLAUSE_END.search(w)) for w in words]
            target = [fixed.get(letters(w)) == "target" for w in words]
            own = {k: t for k, w in enumerate(words) if (t := term(w))}
            held.update(set(own.values()))
            after.update({t for k, t in own.items() if any(target[k + 1 : k + 2]) and not ends[k] or any(target[k + 2 : k + 3]) and not any(ends[k : k + 2])})
    threats |= {t for t in chosen if after[t] >= toxicity.MIN_SUPPORT and 2 * after[t] >= held[t]}

    def lexicon(word):
        found = term(word)
        return ("threat" if found in threats else "insult") if found else fixed.get(letters(word), "other")

    def features(text):
        words, clause, sums, hit = (text or "").split(), [], dict.fromkeys(toxicity.MATCHES, 0.0), 0
        for k, word in enumerate(words):
            clause.append(word)
            if toxicity._CLAUSE_END.search(word) or k == len(words) - 1:
                found = clause_weights(clause, lexicon)
                hit += bool(found)
                for kind, weight in found:
                    sums[kind] += weight
                clause = []
        total = sum(sums.values())
        return [*(math.log1p(sums[k]) for k in toxicity.MATCHES), float(total > 0), math.log1p(hit), total / (len(words) + 20.0)]

    x = {i: features(text) for i, text in docs}
    learned = sorted(labels)
    table = np.c_[[x[i] for i in learned], np.ones(len(learned))]
    y, w = np.array([labels[i] for i in learned], float), np.zeros(table.shape[1])
    ridge = np.r_[np.ones(len(w) - 1), 1e-6]
    for _ in range(100):
        p = 1 / (1 + np.exp(-table @ w))
        w -= np.linalg.solve((table.T * (p * (1 - p))) @ table + np.diag(ridge), table.T @ (p - y) + ridge * w)
    return {i: 1 / (1 + math.exp(-np.clip(np.dot([*v, 1.0], w), -40, 40))) for i, v in x.items()}


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_toxicity_query_equals_a_plain_program(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    ids, labels = {i for i, _ in docs}, {}
    for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL").collect():
        if not held_out(r["doc_id"]) and r["doc_id"] in ids:
            labels[r["doc_id"]] = max(r["toxic"], labels.get(r["doc_id"], 0))
    want = toxicity_by_hand(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.query(spark, folder).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r["held_out"] == held_out(i) and r["score"] == pytest.approx(want[i], abs=1e-6)
        assert r["predicted"] == (r["score"] >= 0.3)

"""Rows corrected in plain Python, a cell and a word after the other."""

import math
import re

from textloom.functions.distance import STATIC_COSTS

DIGRAPHS = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("nn", "m"), ("ii", "u"), ("li", "h"), ("ri", "n")]
FLAGGED = {"number": 0.8, "title": 0.95, "dosage": 0.8, "room_code": 0.7}


def weighted(a, b, costs=STATIC_COSTS, other=1.0):
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [i + 1.0]
        for j, y in enumerate(b):
            sub = 0.0 if x == y else costs.get(",".join(sorted((x, y))), other)
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + sub))
        row = new
    return row[-1]


def cased(original, word):
    if original == original.upper() and len(original) > 1:
        return word.upper()
    if original[:1] == original[:1].upper() != original[:1].lower():
        return word[:1].upper() + word[1:].lower()
    return word.lower() if original == original.lower() else word


def form(w):
    return re.sub("[^a-z0-9]", "", w.lower()).translate(str.maketrans("013568i", "olesgbl"))


def cuts(f):
    return {f[:i] + f[i + 1 :] for i in range(len(f))} - {""}


def indexed(q, w, spread):
    """Whether the index of forms, deletions, beginnings and endings gives w for q."""
    a, b, near = form(q), form(w), abs(len(q) - len(w)) <= spread
    ends = a[:2] == b[:2] or a[-2:] == b[-2:]
    return a == b or bool(({a} | cuts(a)) & cuts(b)) or (near and ends)


def guard(w):
    digits, letters = len(re.findall("[0-9]", w)), len(re.findall("[A-Za-z]", w))
    if re.fullmatch(r"[\d.,/\-:]+", w):
        return "number"
    if re.fullmatch(r"(?i)(dr|mr|mrs|ms|prof)\.?", w):
        return "title"
    if re.fullmatch(r"(?i)[\doOil]+(\.[\doOil]+)?\s*(mg|mcg|g|ml|units?|iu|%|mmol|meq)", w):
        return "dosage"
    if len(w) <= 6 and digits and letters and not re.fullmatch(r"[a-zA-Z]{2,}\d[a-zA-Z]{2,}", w):
        if (digits >= 2 and w[0].isdigit()) or (w == w.upper() and len(w) <= 5) or "-" in w:
            return "room_code"
    return None


class Corrector:
    def __init__(self, vocab, column_words=(), frequency=None, chains=None, resonance=None, common=(), meds=(), ocr=False):
        self.base, self.cw, self.freq, self.chains = set(vocab), set(column_words), frequency or {}, chains or {}
        self.res, self.common, self.meds, self.ocr = resonance or {}, set(common), set(meds), ocr
        self.words = self.base | set(self.freq)

    def boost(self, w):
        return math.log(1 + self.freq.get(w, 0)) / math.log(101)

    def word(self, w, col, known):
        low, n = w.lower(), len(w)
        g = guard(w)
        if g:
            return w, FLAGGED[g], g
        if n <= 3 and low not in self.base:
            return w, 0.4, "short_unknown"
        if 2 * len(re.findall("[A-Za-z]", w)) < n:
            return w, 0.6, "punctuation"
        if low in self.words:
            keep = (w == w.upper() and n <= 5) or (w[0] == w[0].upper() and w[1:] == w[1:].lower())
            return w if keep else low, min(0.9 + 0.1 * self.boost(low), 1.0), "exact"
        if low in self.common:
            return w, 0.85, "clean"
        fixed = low
        for pair, one in DIGRAPHS:
            fixed = fixed.replace(pair, one)
        if fixed != low and fixed in self.words:
            return cased(w, fixed), 0.85, "digraph_corrected"
        return self.fuzzy(w, low, n, col, known)

    def fuzzy(self, w, low, n, col, known):
        o = self.ocr
        most = max(n * (0.45 if o else 0.35), 1.0) if n <= 4 else max(n * (0.55 if o else 0.45), 2.0)
        apart = (2 if o else 1) if n <= 4 else (3 if o else 2)
        found = []
        for v in self.words:
            d = weighted(low, v)
            if abs(len(v) - n) > apart or d > most or not indexed(low, v, 2 if o else 1):
                continue
            e, m = weighted(low, v, {}), max(n, 3)
            chain = sum(0.3 * math.log(1 + self.chains.get((c, x, col.lower()), {}).get(v, 0)) for c, x in known)
            s = [1 - d / e if e else 1.0, float((col, v) in self.cw), min(self.boost(v), 1), min(chain, 1), min(self.res.get((low, v), 0), 1), max(0, 1 - abs(len(v) - n) / m), max(0, 1 - d / m), 0]
            firing = sum(x > 0.3 for x in s)
            found.append((-round(sum(s) / 8 + (0.3 if firing >= 3 else 0.1 if firing == 2 else 0), 9), round(d, 9), v, e))
        if not found:
            return w, 0.0, "unknown"
        found.sort()
        score, d, best, e = -found[0][0], *found[0][1:]
        margin = score + (found[1][0] if len(found) > 1 else 0)
        if not (re.search("[0-9]", w) and re.search("[A-Za-z]", w)) and e:
            ratio = d / e
            limit = (0.6 if o else 0.35) if n <= 4 else (0.8 if o else 0.55)
            weak = ratio >= limit and not (e <= 1 and len(best) != n) and not (e <= 1 and n >= 8)
            far = (e >= (6 if o else 3) or (e >= (3 if o else 2) and n <= 5)) and ratio >= 0.2
            if weak or far:
                return w, 0.0, "clean"
        conf = max(score, 0.6) if e <= 1 else score
        conf = min(conf, 1.0)
        if len(found) > 1 and best in self.meds and found[1][2] in self.meds and round(margin, 9) < 0.2 and e > 1:
            return w, min(conf, 0.3), "DANGER_medication_ambiguity"
        if conf > 0.8 and margin > 0.15:
            return cased(w, best), conf, "high_confidence"
        if conf > 0.5:
            return (cased(w, best) if e <= 2 else w), conf, "corrected_verify"
        return w, conf, "low_confidence"

    def row(self, cells):
        """cells: (col, text) in order; gives {col: (output, [(corrected, confidence, flag)])}, before numbers are rewritten."""
        known, out = [], {}
        for col, text in cells:
            if not text or not text.split():
                out[col] = (text, [])
                continue
            words = []
            for token in text.split():
                lead = re.match("[^a-zA-Z0-9]*", token)[0]
                rest = token[len(lead):]
                trail = re.search("[^a-zA-Z0-9]*$", rest)[0]
                core = rest[: len(rest) - len(trail)]
                c, conf, flag = self.word(core, col, known) if core else ("", 0.6, "punctuation")
                words.append((lead + c + trail, conf, flag))
            out[col] = (" ".join(x[0] for x in words), words)
            known.append((col.lower(), out[col][0].lower()))
        return out

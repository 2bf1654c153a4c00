"""The waves of a small corpus by plain dictionaries, to hold the tables against."""

import math
from collections import Counter, defaultdict


class Net:
    def __init__(self, sentences):
        self.near, self.next, self.skip, self.res = (defaultdict(Counter) for _ in range(4))
        self.freq, prev = Counter(), defaultdict(Counter)
        for ws in sentences:
            for i, a in enumerate(ws):
                self.freq[a] += 1
                for j, b in enumerate(ws):
                    if i != j and abs(i - j) <= 3:
                        self.near[a][b] += 1
                    if j == i + 1:
                        self.next[a][b] += 1
                        prev[b][a] += 1
                    if 2 <= j - i <= 7:
                        self.skip[a][b] += 1 / (j - i)
        for table, other in ((self.next, True), (prev, False)):
            for src in list(table):
                best = self.top(table[src], 5)
                for w, n in table[src].items():
                    for t, _ in best:
                        if t != w:
                            self.res[w][t] += n / 10
                            self.res[t][w] += n / 10
        n, d = sorted(self.freq.values()), sorted(len(self.near[w]) for w in self.freq)
        mn, md = max(n[len(n) // 2], 1), max(d[len(d) // 2], 1)
        self.damp = {w: min(max(0.5 / math.log2(self.freq[w] / mn + 2) + 0.5 / math.log2(len(self.near[w]) / md + 2), 0.1), 1.0) for w in self.freq}

    @staticmethod
    def top(table, k):
        return sorted(table.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]

    def wave(self, w, context=None):
        field = defaultdict(float, {w: 1.0})
        most = max([*context.values(), 1e-9]) if context else 0

        def excite(t, e):
            gate = 0.4 + 1.1 * context.get(t, 0.0) / most if context else 1.0
            field[t] += e * self.damp[t] * gate

        def send(table, k, e, shared=True):
            best = self.top(table, k)
            for t, n in best:
                excite(t, e * (n / sum(x for _, x in best) if shared else min(0.6 + 0.08 * n, 0.95)))

        send(self.near[w], 15, 0.3 * 0.30)
        send(self.next[w], 15, 0.3 * 0.25)
        send(self.res[w], 15, 0.3 * 0.25, False)
        send(self.skip[w], 15, 0.3 * 0.20)
        best = [n for n, _ in self.top({n: e for n, e in field.items() if n != w}, 10)]
        for node in [n for n in best if set(self.near[n]) & set(self.near[w]) or n in self.res[w]][:5]:
            send(self.near[node], 8, 0.09 * 0.30)
            send(self.next[node], 8, 0.09 * 0.25)
            send(self.res[node], 8, 0.09 * 0.25, False)
        return dict(field)

    @staticmethod
    def cosine(a, b):
        na, nb = (math.sqrt(sum(e * e for e in x.values())) for x in (a, b))
        return 0.0 if na < 1e-9 or nb < 1e-9 else sum(e * b.get(n, 0.0) for n, e in a.items()) / (na * nb)

    def settle(self, field):
        field = dict(field)
        for i in range(1, 4):
            before, best = dict(field), self.top(field, 8)
            for node, energy in best:
                if node in self.freq:
                    for t, e in self.wave(node).items():
                        if t != node:
                            field[t] = field.get(t, 0.0) + e * 0.5**i * energy / best[0][1]
            if 1 - self.cosine(before, field) < 0.01:
                return field, i, True
        return field, 3, False

    def expected(self, a, b):
        table = {t: float(n) for t, n in self.next[a].items()}
        for p, r in self.top({p: r for p, r in self.res[a].items() if self.next[p]}, 5):
            for t, n in self.next[p].items():
                table.setdefault(t, n * min(0.6 + 0.08 * r, 0.95))
        order = [t for t, _ in self.top(table, len(table))]
        return 0.4 * table[b] / max(sum(table.values()), 1) + 0.6 * (1 - order.index(b) / len(order)) if b in table else 0.0

    def score(self, ws):
        field, steps, total = {}, [], 0.0
        for i, w in enumerate(ws):
            wave = self.wave(w, field or None)
            if i:
                r, s, q = min(field.get(w, 0.0) / max(field.values()), 1), self.cosine(wave, field), self.expected(ws[i - 1], w)
                steps.append((0.3 * (1 - r) + 0.4 * (1 - q) + 0.3 * (1 - s), q))
            for n, e in wave.items():
                field[n] = field.get(n, 0.0) + e
        surprise = sum(s for s, _ in steps) / len(ws)
        for i, (s, q) in enumerate(steps):
            before = steps[:i]
            consistent = sum(x < 0.7 for x, _ in before) / len(before) if before else 0.5
            retro = min(field[ws[i + 1]] / max(field.values()), 1)
            total += s * (1 - retro * max(q, 0.05) * (0.4 + 0.6 * consistent) * 0.6)
        correct = 1 - min(total / len(ws), 1)
        end, rounds, converged = self.settle(field)
        e = sorted(end.values(), reverse=True)
        settled = 0.8 * correct + 0.2 * sum(e[: max(1, int(len(e) * 0.2))]) / sum(e)
        return (len(ws), surprise, 1 - min(surprise, 1), correct, settled, rounds, converged), end

    def _field(self, words):
        field = {}
        for w in words:
            for n, e in self.wave(w, field or None).items():
                field[n] = field.get(n, 0.0) + e
        return field

    def fit(self, w, field):
        return (self.cosine(self.wave(w), field) if field else 0.0) + field.get(w, 0.0)

    def choose_line(self, words, offers, nearest):
        words = list(words)
        for p in sorted(offers):
            if words[p] in self.freq or not offers[p]:
                continue
            field = self._field([w for i, w in enumerate(words) if i != p])
            score, best = max((round(self.fit(c, field) + 0.01 * (c in self.freq), 12), -i) for i, c in enumerate(offers[p]))
            if score > 0.001:
                words[p] = offers[p][-best]
                continue
            via = [(round(self.fit(nearest[c], field), 12), -i) for i, c in enumerate(offers[p]) if c in nearest]
            if via and max(via)[0] > 0.001:
                words[p] = offers[p][-max(via)[1]]
        return words

    def read(self, words, offers, nearest):
        out = []
        for i, w in enumerate(words):
            field, offered = self._field(out), offers.get(i)
            if offered and w in self.freq and w not in offered:
                better = [c for c in offered if c in self.freq and self.fit(c, field) > self.fit(w, field) + 0.05]
                w = better[-1] if better else w
            elif offered and w not in self.freq:
                score, best = max((round(self.fit(c, field) + 0.01 * (c in self.freq), 12), -k) for k, c in enumerate(offered))
                via = [(round(self.fit(nearest[c], field), 12), -k) for k, c in enumerate(offered) if c in nearest]
                if score > 0.001:
                    w = offered[-best]
                elif via and max(via)[0] > 0.001:
                    w = offered[-max(via)[1]]
            out.append(w)
        return out

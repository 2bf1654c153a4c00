"""Words' vectors and their likeness on a small corpus, word by word in plain Python."""

import math
from collections import Counter, defaultdict

from tests.wave_brute import Net


def mean(a):
    return sum(a) / len(a) if a else 0.0


def sd(a):
    return math.sqrt(mean([(x - mean(a)) ** 2 for x in a]))


def cosine(x, y):
    n = math.sqrt(sum(a * a for a in x)), math.sqrt(sum(b * b for b in y))
    return 0.0 if min(n) < 1e-6 else sum(a * b for a, b in zip(x, y, strict=True)) / (n[0] * n[1])


class Words:
    def __init__(self, sentences):
        self.net, self.n_sent = Net(sentences), len(sentences)
        self.at, self.ns, self.len, self.div, self.rare, self.change, prev = *(defaultdict(list) for _ in range(6)), {}
        self.all_at, self.all_len, freq, self.before = [], [], Counter(), defaultdict(Counter)
        for ns, ws in enumerate(sentences, 1):
            self.all_len.append(len(ws))
            for i, w in enumerate(ws):
                freq[w] += 1
                rp = i / max(len(ws) - 1, 1)
                around = {x for j, x in enumerate(ws) if j != i and abs(i - j) <= 3}
                mates = [x for x in ws if x != w]
                self.all_at.append(rp)
                self.at[w].append(rp)
                self.ns[w].append(ns)
                self.len[w].append(len(ws))
                self.div[w].append(len(set(ws)) / len(ws))
                self.rare[w].append(mean([freq[m] < 3 for m in mates]))
                if w in prev:
                    self.change[w].append(1 - len(prev[w] & around) / len(prev[w] | around))
                prev[w] = around
                if i:
                    self.before[w][ws[i - 1]] += 1

    def jaccard(self, a, b):
        x, y = set(self.net.near[a]), set(self.net.near[b])
        return len(x & y) / len(x | y)

    def context(self, w):
        near, freq = self.net.near[w], self.net.freq
        best, total = Net.top(near, 10), sum(near.values())
        logs = [math.log2(freq[b] + 1) for b, _ in best[:5]]
        at = [p for b, _ in best for p in self.at[b][-10:]]
        mine = self.at[w][-100:]
        apart = 1 - self.jaccard(w, best[0][0]) if len(near) >= 2 else 0
        return [min(len(near) / 30, 1), best[0][1] / total, sum(n for _, n in best[:3]) / total, mean(logs) / 10, sd(logs) / 5, mean(at), sd(at), mean(mine), sd(mine), apart, min(math.log2(freq[w] + 1) / 10, 1), total / freq[w] / 10]

    def history(self, w):
        n, ns, every = self.net.freq[w], self.ns[w], self.n_sent
        gaps = [y - x for x, y in zip(ns, ns[1:], strict=False)][-50:]
        steady = 1 - min(sd(gaps) / (mean(gaps) + 1e-3), 2) / 2 if len(gaps) > 1 else 0.5 * len(gaps)
        at = self.at[w][-50:]
        return [min(math.log2(n + 1) / 10, 1), min((every - ns[0] + 1) / every, 1), max(0, 1 - (every - ns[-1]) / every), steady, 1 - min(sd(at) * 3, 1) if len(at) > 1 else 0, mean(at), mean(self.change[w][-50:]), min(n / 10, 1)]

    def influence(self, w):
        near, sl = self.net.near[w], self.len[w][-50:]
        best = [b for b, _ in Net.top(near, 10)]
        pairs = [b in self.net.near[a] for i, a in enumerate(best) for b in best[i + 1 :]]
        h = len(sl) // 2
        even = 1 - min(abs(mean(sl[h:]) - mean(sl[:h])) / mean(sl[:h]), 1) if len(sl) >= 4 else 0
        return [min(mean(sl) / 15, 1), min(sd(sl) / 5, 1), mean(self.rare[w][-50:]), mean(self.div[w][-50:]), 1 - mean(pairs) if len(near) >= 3 else 0, abs(mean(self.at[w][-100:]) - 0.5) * 2, min(sd([math.log2(self.net.freq[b] + 1) for b in best]) / 3, 1), even]

    def contrast(self, w):
        freq, at, sl = self.net.freq, self.at[w][-100:], self.len[w][-50:]
        fm, dm, most = mean(list(freq.values())), mean([len(self.net.near[x]) for x in freq]), max(freq.values())
        chief = min(x for x in freq if freq[x] == most)
        every, lm, h = self.all_at[-500:], mean(self.all_len[-200:]), len(at) // 2
        off = lambda x, m: min(abs(x - m) / m, 2) / 2
        narrow = max(0, 1 - sd(at[h:]) / sd(at[:h])) if len(at) >= 6 and sd(at[:h]) > 1e-9 else 0
        return [off(freq[w], fm), min(abs(mean(at) - mean(every)) * 3, 1), min(abs(sd(at) - sd(every)) * 5, 1) if len(at) > 1 else 0, min(abs(mean(sl) - lm) / max(lm, 1), 1), off(len(self.net.near[w]), dm), 1 - self.jaccard(w, chief), 1 - freq[w] / most, narrow]

    def expectation(self, w):
        nx, px = self.net.next[w], self.before[w]
        part = lambda t, k: sum(n for _, n in Net.top(t, k)) / sum(t.values()) if t else 0
        apart = 1 - len(set(nx) & set(px)) / len(set(nx) | set(px)) if nx and px else 0
        return [part(nx, 1), min(len(nx) / 15, 1), part(px, 1), min(len(px) / 15, 1), abs(part(nx, 1) - part(px, 1)), min((len(nx) + len(px)) / 20, 1), apart, part(nx, 3)]

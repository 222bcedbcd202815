"""Greedy string tiling straight from its definition, for the tests."""


def tiles_brute(text, item, width):
    """Greedy string tiling straight from its definition."""
    t, s, out = [None] * len(text), [None] * len(item), []
    while True:
        best = (0, 0, 0)
        for a in range(len(text)):
            for b in range(len(item)):
                k = 0
                while a + k < len(text) and b + k < len(item) and text[a + k] == item[b + k] and not t[a + k] and not s[b + k]:
                    k += 1
                if k > best[0]:
                    best = (k, a, b)
        if best[0] < width:
            return sorted(out)
        k, a, b = best
        out.append((a, b, k))
        for i in range(k):
            t[a + i] = s[b + i] = True

"""Best partners between two packs of names: the left names walk down a tree of the right names' texts.

Score and bounds are those of token-set and token-sort ratios (:mod:`kestrel.functions.text`).  Texts of
n and m letters with a common subsequence of c score 200 * c / (n + m).  The right texts of a pack make a
tree, a letter a level, and every left name goes down it with its bit-parallel alignment so far, many
names and nodes in one array.  It leaves a node when even a full match of all letters that still follow
stays below the least score that matters; what is asked for falls in steps from 100, so a name with a
near partner never sees the rest of the tree.

The token-set ratio puts the tokens that both names hold first.  So each set of tokens that a left and
a right name may share has a tree of its own, of the right names' other tokens, and a pair counts in the
tree of just those tokens that it shares; the tree of whole names gives token-sort ratios, and
token-set ratios of pairs that share none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from kestrel.functions.text import _indel

#: Letters of a name, a bit each, and tokens of which all subsets are taken; other names are scored one by one.
WIDEST, SUBSETS = 63, 6
#: By how much the score asked for falls, left texts that walk at once, and children looked at in one array.
STEP, WALKERS, FRONT = 4.0, 1 << 14, 1 << 19
EPS = 1e-9


def sort_ratio(a: list[str], b: list[str]) -> float:
    return _indel(" ".join(a), " ".join(b))


def set_ratio(a: list[str], b: list[str]) -> float:
    both = [t for t in dict.fromkeys(a) if t in b]
    x, y = ([t for t in dict.fromkeys(own) if t not in both] for own in (a, b))
    if not a or not b:
        return 0.0
    if both and not (x and y):
        return 100.0
    base, p, q = " ".join(both), " ".join(both + x), " ".join(both + y)
    prefix = max(200.0 * len(base) / (len(base) + len(p)), 200.0 * len(base) / (len(base) + len(q))) if both else 0.0
    return max(_indel(p, q), prefix)


def _letters(texts: list[str]) -> np.ndarray:
    """Code points, a row a text, with a zero at least behind each."""
    told = np.array(texts, dtype=f"<U{max(map(len, texts), default=0) + 1}")
    return told.view(np.uint32).reshape(len(texts), -1)


def _alike(raw: np.ndarray) -> np.ndarray:
    """Letters at the start that each row has in common with the one before; -1 for the first."""
    same = raw[1:] == raw[:-1]
    return np.concatenate([[-1], np.where(same.all(axis=1), raw.shape[1], same.argmin(axis=1))])


class Tree:
    """Right texts by group: the nodes of a level are prefixes of so many letters, in order, so that children are ranges."""

    def __init__(self, group: np.ndarray, texts: list[str], total: np.ndarray, name: np.ndarray, letters: np.ndarray):
        order = np.argsort(np.array(texts), kind="stable")
        order = order[np.argsort(group[order], kind="stable")]
        raw, group, total, self.name = _letters(texts)[order], group[order], total[order], name[order]
        self.total, self.length = total, (raw > 0).sum(axis=1)
        alike = _alike(raw)
        alike[1:][group[1:] != group[:-1]] = -1
        at = np.minimum(np.searchsorted(letters, raw), len(letters) - 1)
        codes = np.where(letters[at] == raw, at + 1, 0)  # 0: no left name has this letter
        self.row = [np.flatnonzero((alike < k) & (self.length >= k)) for k in range(int(self.length.max()) + 1)]
        self.code = [np.zeros(len(self.row[0]), dtype=np.int64), *(codes[r, k] for k, r in enumerate(self.row[1:]))]
        self.least = [np.minimum.reduceat(total, r) for r in self.row]
        self.most = [np.maximum.reduceat(total, r) for r in self.row]
        self.kids = []
        for k, r in enumerate(self.row):
            below = self.row[k + 1] if k + 1 < len(self.row) else r[:0]
            parent = np.searchsorted(r, below, "right") - 1
            self.kids.append([np.searchsorted(parent, np.arange(len(r)), side) for side in ("left", "right")])
        self.root = dict(zip(group[self.row[0]].tolist(), range(len(self.row[0])), strict=True))


class Best:
    """Highest score of each left name by either ratio, with the smallest right name that has it, and what still matters."""

    def __init__(self, hints: np.ndarray, least_set: float, least_sort: float | None, first: bool):
        self.first, self.sorts = first, least_sort is not None
        self.score = {k: np.full(len(hints), -1.0) for k in ("set", "sort")}
        self.name = {k: np.full(len(hints), -1) for k in ("set", "sort")}
        self.least = {"set": np.full(len(hints), float(least_set)), "sort": np.full(len(hints), float(least_sort) if self.sorts else np.inf)}
        told = np.flatnonzero(hints >= least_set)
        self._raise("set", told, hints[told])

    def _raise(self, kind: str, who: np.ndarray, score: np.ndarray) -> None:
        self.least[kind][who] = np.maximum(self.least[kind][who], score)
        if self.first and kind == "set":
            self.least["sort"][who] = np.inf
        elif not self.first:
            other = "sort" if kind == "set" else "set"
            self.least[other][who] = np.maximum(self.least[other][who], score)

    def offer(self, kind: str, who: np.ndarray, name: np.ndarray, score: np.ndarray) -> None:
        fits = score >= self.least[kind][who] - EPS
        who, name, score = who[fits], name[fits], score[fits]
        order = np.lexsort((name, -score, who))
        order = order[np.concatenate([[True], np.diff(who[order]) > 0])[: len(order)]]
        who, name, score = who[order], name[order], score[order]
        old = self.score[kind][who]
        better = (score > old) | ((score == old) & (name < self.name[kind][who]))
        self.score[kind][who[better]], self.name[kind][who[better]] = score[better], name[better]
        self._raise(kind, who, score)


class Walk:
    """Left texts, each with the root of its tree; a walk offers all pairs that reach a score."""

    def __init__(self, tree: Tree, best: Best, texts: list[str], letters: np.ndarray, root, who, base, shared, total, left_tokens, right_tokens):
        self.tree, self.best, self.texts, self.letters = tree, best, np.array(texts, dtype=object), letters
        self.root, self.who, self.base, self.shared, self.total = root, who, base, shared, total
        self.tokens = left_tokens, right_tokens

    def down(self, entries: np.ndarray, low: float) -> int:
        """Offers all pairs of the entries from a score of ``low``; how many children were looked at."""
        parts = (entries[self.base[entries] == 0], entries[self.base[entries] > 0])
        return sum(self._down(own[k : k + WALKERS], low) for own in parts for k in range(0, len(own), WALKERS))

    def _down(self, some: np.ndarray, low: float) -> int:
        raw = _letters(self.texts[some].tolist())
        n = (raw > 0).sum(axis=1)
        codes = np.searchsorted(self.letters, raw) + 1
        places = np.zeros((len(some), len(self.letters) + 1), dtype=np.uint64)
        for i in range(raw.shape[1] - 1):
            own = np.flatnonzero(n > i)
            places[own, codes[own, i]] |= np.uint64(1 << i)
        full = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
        who, base, total, whole = self.who[some], self.base[some], self.total[some], self.shared[some] == 0
        held = np.maximum(base - 1, 0)
        tree, best = self.tree, self.best

        def needed(e: np.ndarray) -> np.ndarray:
            of_set, of_sort = best.least["set"][who], best.least["sort"][who]
            return (np.maximum(np.where(whole, np.minimum(of_set, of_sort), of_set), low) - EPS)[e]

        def prefix(e: np.ndarray, m: np.ndarray) -> np.ndarray:
            return 200.0 * held[e] / (held[e] + np.minimum(total[e], m))

        def reached(k: int, node: np.ndarray, e: np.ndarray, c: np.ndarray) -> None:
            row = tree.row[k][node]
            ends = np.flatnonzero(tree.length[row] == k)
            row, e, c = row[ends], e[ends], c[ends]
            m = tree.total[row]
            score = np.minimum(np.maximum(200.0 * (base[e] + c) / (total[e] + m), prefix(e, m)), 100.0)
            good = np.flatnonzero(score >= needed(e))
            row, e, score = row[good], e[good], score[good]
            name, mine = tree.name[row], who[e]
            if best.sorts:
                sorts = whole[e]
                best.offer("sort", mine[sorts], name[sorts], score[sorts])
            both = np.zeros(len(e), dtype=np.int64)
            for own in self.tokens[0].T:
                both += (own[mine][:, None] == self.tokens[1][name]).sum(axis=1)
            sets = both == self.shared[some[e]]
            best.offer("set", mine[sets], name[sets], score[sets])

        e = np.arange(len(some))
        reached(0, self.root[some], e, np.zeros(len(e), dtype=np.int64))
        stack, seen = [(0, self.root[some], e, full)], 0
        while stack:
            k, node, e, state = stack.pop()
            lo, hi = (side[node] for side in tree.kids[k])
            count = hi - lo
            if len(e) > 1 and count.sum() > FRONT:
                half = len(e) // 2
                stack += [(k, node[half:], e[half:], state[half:]), (k, node[:half], e[:half], state[:half])]
                continue
            up = np.repeat(np.arange(len(e)), count)
            if not len(up):
                continue
            seen += len(up)
            child = np.arange(len(up)) + np.repeat(lo - (np.cumsum(count) - count), count)
            e, state = e[up], state[up]
            hit = state & places[e, tree.code[k + 1][child]]
            state = (state + hit) | (state - hit)
            c = n[e] - np.bitwise_count(state & full[e]).astype(np.int64)
            # The bound rises with the right text's length until all of the left one may be matched, then falls.
            least, most = tree.least[k + 1][child], tree.most[k + 1][child]
            m = np.clip(n[e] - c + base[e] + k + 1, least, most)
            most_common = base[e] + np.minimum(n[e], c + np.maximum(m - base[e] - k - 1, 0))
            bound = np.minimum(200.0 * most_common / (total[e] + m), 100.0)
            if held.any():
                bound = np.maximum(bound, prefix(e, least))
            kept = np.flatnonzero(bound >= needed(e))
            if len(kept):
                child, e, state = child[kept], e[kept], state[kept]
                reached(k + 1, child, e, c[kept])
                stack.append((k + 1, child, e, state))
        return seen


def _token_sets(tokens: list[list[str]], others: set[str]) -> Iterator[tuple[int, tuple[str, ...]]]:
    """(name, tokens that it may share): every set of its tokens that are among the others'."""
    for k, own in enumerate(tokens):
        own = [t for t in own if t in others]
        yield from ((k, some) for some in chain.from_iterable(combinations(own, r) for r in range(1, len(own) + 1)))


def _walked(left: list[list[str]], right: list[list[str]], rank: np.ndarray, who: np.ndarray, best: Best) -> int:
    """Best partners of names without repeated tokens; ``rank`` numbers the right names, ``who`` the left ones.  How many children were looked at."""
    forms = [[" ".join(t) for t in side] for side in (left, right)]
    # The direction whose texts have more in common has the smaller tree.
    alike = [_alike(_letters(sorted(own))).clip(0).sum() for own in (forms[1], [f[::-1] for f in forms[1]])]
    turn = slice(None, None, -1 if alike[1] > alike[0] else 1)
    ours, theirs = ({t for own in side for t in own} for side in (left, right))
    number: dict[tuple[str, ...], int] = {(): 0}
    mine = [(k, (), number[()]) for k in range(len(left))]
    mine += [(k, some, number.setdefault(some, len(number))) for k, some in _token_sets(left, theirs)]
    other = [(k, (), 0) for k in range(len(right))]
    other += [(k, some, number[some]) for k, some in _token_sets(right, ours) if some in number]

    def rest(tokens: list[list[str]], k: int, some: tuple[str, ...]) -> str:
        return " ".join(t for t in tokens[k] if t not in some)[turn]

    letters = np.unique(_letters(forms[0]))
    letters = letters[letters > 0]
    size = [np.array([len(f) for f in own]) for own in forms]
    at = np.array([k for k, _, _ in other])
    tree = Tree(np.array([g for _, _, g in other]), [rest(right, k, some) for k, some, _ in other], size[1][at], rank[at], letters)
    mine = [x for x in mine if x[2] in tree.root]
    own = np.array([k for k, _, _ in mine])
    base = np.array([sum(map(len, some)) + len(some) for _, some, _ in mine])
    code = {t: k for k, t in enumerate(sorted(ours | theirs))}
    wide = [max(map(len, side)) for side in (left, right)]
    left_tokens = np.full((int(who.max()) + 1, wide[0]), -1)
    right_tokens = np.full((int(rank.max()) + 1, wide[1]), -2)
    for told, side, place in ((left_tokens, left, who), (right_tokens, right, rank)):
        for k, tokens in zip(place, side, strict=True):
            told[k, : len(tokens)] = [code[t] for t in tokens]
    walk = Walk(
        tree, best, [rest(left, k, some) for k, some, _ in mine], letters, np.array([tree.root[g] for _, _, g in mine]),
        who[own], base, np.array([len(some) for _, some, _ in mine]), size[0][own], left_tokens, right_tokens,
    )
    low, entries, seen = 100.0, np.arange(len(mine)), 0
    while len(entries):
        low -= STEP
        seen += walk.down(entries, low)
        entries = entries[np.minimum(best.least["set"], best.least["sort"])[walk.who[entries]] < low - EPS]
    return seen


def partners(
    left: tuple[list[str], list[str], list[float]], right: tuple[list[str], list[str]], least_set: float, least_sort: float | None, first: bool
) -> Iterator[tuple]:
    """(name, set, set_r, sort, sort_r): the best partners of the left names (names, forms, scores known to be reached) in a pack."""
    of_form: dict[str, str] = {}
    for name, form in zip(*right, strict=True):  # names of the same tokens score alike: the smallest stands for them
        of_form[form] = min(of_form.get(form, name), name)
    names = sorted(of_form.values())
    rank = {n: k for k, n in enumerate(names)}
    asked = list(dict.fromkeys(left[1]))
    hints = np.full(len(asked), -1.0)
    place = {f: k for k, f in enumerate(asked)}
    np.maximum.at(hints, [place[f] for f in left[1]], left[2])
    best = Best(hints, least_set, least_sort, first)
    sides = [[(k, f.split(" ") if f else []) for k, f in own] for own in (enumerate(asked), ((rank[n], f) for f, n in of_form.items()))]
    vocabulary = [{t for _, own in side for t in own} for side in sides]

    def odd(tokens: list[str], others: set[str]) -> bool:
        text = " ".join(tokens)
        return not text or len(text) > WIDEST or "\0" in text or len(set(tokens)) < len(tokens) or sum(t in others for t in tokens) > SUBSETS

    plain, rare = ([[x for x in side if odd(x[1], others) is is_odd] for side, others in zip(sides, vocabulary[::-1], strict=True)] for is_odd in (False, True))
    if all(plain):
        _walked([t for _, t in plain[0]], [t for _, t in plain[1]], np.array([k for k, _ in plain[1]]), np.array([k for k, _ in plain[0]]), best)
    for some, others in ((rare[0], sides[1]), (plain[0], rare[1])):
        if not others:
            continue
        at = np.array([k for k, _ in others])
        for k, tokens in some:
            who = np.full(len(at), k)
            best.offer("set", who, at, np.array([set_ratio(tokens, t) for _, t in others]))
            if best.sorts:
                best.offer("sort", who, at, np.array([sort_ratio(tokens, t) for _, t in others]))
    for name, form in zip(left[0], left[1], strict=True):
        k = place[form]
        s, t = ((float(best.score[x][k]), names[best.name[x][k]]) if best.name[x][k] >= 0 else (None, None) for x in ("set", "sort"))
        if s[1] or t[1]:
            yield name, *s, *t


def scored(batches: Iterator[pa.RecordBatch], block: int, least: float) -> Iterator[pa.RecordBatch]:
    """(block, l, hint): the token-set ratio of rows (block, l, tokens, tokens) where it reaches ``least``."""
    for batch in batches:
        a, b = (batch.column(block + k).to_pylist() for k in (1, 2))
        told = pa.array([set_ratio(x, y) for x, y in zip(a, b, strict=True)], pa.float64())
        out = pa.RecordBatch.from_arrays([*batch.columns[: block + 1], told], names=[*batch.schema.names[: block + 1], "hint"])
        yield out.filter(pa.compute.greater_equal(told, least))


def compared(batches: Iterator[pa.RecordBatch], block: int, least_set: float, least_sort: float | None, first: bool) -> Iterator[pa.RecordBatch]:
    """(block, l, set, set_r, sort, sort_r) of rows (block, l_names, l_forms, l_hints, r_names, r_forms) that pair two packs."""
    for batch in batches:
        names = [*batch.schema.names[:block], "l", "set", "set_r", "sort", "sort_r"]
        for k in range(batch.num_rows):
            own = [batch.column(block + i)[k].as_py() for i in range(5)]
            out = list(partners(tuple(own[:3]), tuple(own[3:]), least_set, least_sort, first))
            keys = [pa.array([batch.column(j)[k].as_py()] * len(out), batch.schema.types[j]) for j in range(block)]
            kinds = [pa.string(), pa.float64(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array([r[j] for r in out], t) for j, t in enumerate(kinds))], names=names)

"""Segmentation lattices over a unigram vocabulary: best path, marginal likelihood and expected piece counts.

The pieces lie in a double-array trie. Words are handled many at a time: all words of a slab walk the trie and the
recursion in lockstep, one NumPy operation for each start and length, so the cost for each character is a small constant.

A vocabulary whose scores are merge ranks (0, -1, -2, ...) instead of log probabilities is read by Zipf's law: the piece of
rank r gets a probability in proportion to 1 / r. Unusable pieces (control, unknown, scores of -1e8 or less) never match;
single characters always do, at the last rank if their score is that low.
A character that is no piece falls back to the pieces of its UTF-8 bytes, which share the last rank.
"""

from __future__ import annotations

import numpy as np

from .pieces import MARK

#: Cells (words times characters) in a slab.
_SLAB = 1 << 20
#: Cells of the double array that are looked at together for a place.
_WINDOW = 512


class DoubleArray:
    """Trie in two arrays: the child of state s by character code c is t = base[s] + c, if check[t] == s."""

    def __init__(self, words: list[str]):
        often: dict[str, int] = {}
        for w in words:
            for c in w:
                often[c] = often.get(c, 0) + 1
        order = sorted(often, key=lambda c: (-often[c], c))
        self.code_of = np.zeros(0x110000, np.int32)
        for k, c in enumerate(order, 1):
            self.code_of[ord(c)] = k
        self.width = len(order) + 1
        children: list[dict[int, int]] = [{}]
        leaf: list[int] = [-1]
        for i, w in enumerate(words):
            at = 0
            for c in w:
                k = int(self.code_of[ord(c)])
                if k not in children[at]:
                    children[at][k] = len(children)
                    children.append({})
                    leaf.append(-1)
                at = children[at][k]
            leaf[at] = i
        size = 2 * len(children) + 4 * self.width + 8 * _WINDOW
        base, check, term = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = np.zeros(size, bool)
        taken[0] = True
        todo, low = [(0, 0)], 1  # all cells before ``low`` are taken
        for node, state in todo:
            kids = children[node]
            if not kids:
                continue
            codes = sorted(kids)
            while taken[low : low + _WINDOW].all():
                low += _WINDOW
            b = max(1, low - codes[0])
            while True:
                if b + codes[-1] + 2 * _WINDOW > len(taken):
                    grow = len(taken)
                    taken = np.concatenate([taken, np.zeros(grow, bool)])
                    base, check, term = (np.concatenate([x, np.full(grow, v, np.int32)]) for x, v in ((base, 0), (check, -1), (term, -1)))
                fits = ~taken[b + codes[0] : b + codes[0] + _WINDOW]
                for c in codes[1:]:
                    fits &= ~taken[b + c : b + c + _WINDOW]
                if fits.any():
                    b += int(fits.argmax())
                    break
                b += _WINDOW
            base[state] = b
            for c in codes:
                t = b + c
                taken[t] = True
                check[t], term[t] = state, leaf[kids[c]]
                todo.append((kids[c], t))
        last = int(np.flatnonzero(taken)[-1]) + self.width + 2  # so that no step leaves the arrays
        self.base, self.check, self.term = (np.concatenate([x, np.full(max(0, last - len(x)), v, np.int32)])[:last] for x, v in ((base, 0), (check, -1), (term, -1)))

    def find(self, word: str) -> int:
        """The index of ``word``, or -1."""
        s = 0
        for c in word:
            k = int(self.code_of[ord(c)])
            t = int(self.base[s]) + k
            if not k or self.check[t] != s:
                return -1
            s = t
        return int(self.term[s])


class Lattice:
    """``pieces`` and their natural log probabilities; ``byte_ids``: the ids of the 256 byte pieces, or empty."""

    def __init__(self, pieces: list[str], logp: np.ndarray, usable: np.ndarray, byte_ids: np.ndarray):
        self.pieces, self.logp, self.byte_ids = pieces, np.asarray(logp, np.float64), np.asarray(byte_ids, np.int64)
        self.ids = np.flatnonzero(usable)
        self.trie = DoubleArray([pieces[i] for i in self.ids])
        self.longest = max((len(pieces[i]) for i in self.ids), default=1)
        single = np.zeros(self.trie.width, bool)
        for i in self.ids:
            if len(pieces[i]) == 1:
                single[self.trie.code_of[ord(pieces[i])]] = True
        self._single = single

    @classmethod
    def from_model(cls, model: bytes) -> Lattice:
        """Of a SentencePiece file."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        score = np.array([sp.get_score(i) for i in range(n)], np.float64)
        is_byte = np.array([sp.is_byte(i) for i in range(n)])
        usable = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]) & ~is_byte
        usable &= (score > -1e8) | (np.array([len(p) for p in pieces]) == 1)
        byte_ids = np.zeros(0, np.int64)
        if is_byte.sum() == 256:
            byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        return cls(pieces, unigram_logp(score, usable, byte_ids), usable, byte_ids)

    def with_logp(self, logp: np.ndarray) -> Lattice:
        other = object.__new__(Lattice)
        other.__dict__ = self.__dict__ | {"logp": np.asarray(logp, np.float64)}
        return other

    # --- slabs of words

    def _slabs(self, words: list[str]):
        """(indices, lengths, code points) with words of like length, the longest first."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        at = 0
        while at < len(order):
            n = max(1, _SLAB // int(lengths[order[at]]))
            part = order[at : at + n]
            size = lengths[part]
            chars = np.zeros((len(part), size[0]), np.uint32)
            flat = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32)
            chars[np.arange(size[0]) < size[:, None]] = flat
            yield part, size, chars
            at += n

    def _arcs(self, size: np.ndarray, chars: np.ndarray):
        """For each start and length: (start, length, rows, piece ids); id -1 stands for the bytes of one character."""
        codes = self.trie.code_of[chars]
        base, check, term = self.trie.base, self.trie.check, self.trie.term
        for i in range(chars.shape[1]):
            active = int(np.searchsorted(-size, -i, side="left"))  # words longer than i come first
            rows = np.arange(active)
            if len(self.byte_ids):
                other = rows[~self._single[codes[:active, i]]]
            else:
                other = rows[~self._single[codes[:active, i]]][:0]
            if len(other):
                yield i, 1, other, None
            state = np.zeros(active, np.int64)
            for n in range(1, min(self.longest, chars.shape[1] - i) + 1):
                if n > 1:
                    long = size[rows] >= i + n
                    if not long.all():
                        rows, state = rows[long], state[long]
                c = codes[rows, i + n - 1]
                t = base[state] + c
                ok = (check[t] == state) & (c > 0)
                rows, state = rows[ok], t[ok].astype(np.int64)
                if not len(rows):
                    break
                leaf = term[state]
                end = leaf >= 0
                if end.any():
                    yield i, n, rows[end], self.ids[leaf[end]]

    def _byte_logp(self, chars: np.ndarray) -> np.ndarray:
        """Sum of the byte pieces' log probabilities for each code point."""
        out = np.zeros(len(chars))
        for c in np.unique(chars):
            raw = chr(c).encode("utf-8", "replace")
            out[chars == c] = self.logp[self.byte_ids[list(raw)]].sum()
        return out

    def _weight(self, chars, i, rows, ids):
        return self._byte_logp(chars[rows, i]) if ids is None else self.logp[ids]

    # --- recursions

    def viterbi(self, words: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """(piece ids of the best segmentation, its log probability) of each word; of equal paths, the one found first."""
        out, score = [[] for _ in words], np.zeros(len(words))
        for part, size, chars in self._slabs(words):
            best = np.full((len(part), chars.shape[1] + 1), -np.inf)
            best[:, 0] = 0
            back = np.zeros(best.shape, np.int32)
            piece = np.zeros(best.shape, np.int32)
            for i, n, rows, ids in self._arcs(size, chars):
                cand = best[rows, i] + self._weight(chars, i, rows, ids)
                better = cand > best[rows, i + n]
                rows = rows[better]
                best[rows, i + n] = cand[better]
                back[rows, i + n] = n
                piece[rows, i + n] = -1 if ids is None else ids[better]
            score[part] = best[np.arange(len(part)), size]
            at, rows, steps = size.copy(), np.arange(len(part)), []
            while len(rows):
                here = at[rows]
                if not (back[rows, here] > 0).all():
                    raise ValueError("the vocabulary has no bytes to fall back to")
                steps.append((rows, piece[rows, here], here))
                at[rows] = here - back[rows, here]
                rows = rows[at[rows] > 0]
            for rows, ids, here in reversed(steps):
                for r, k, e in zip(part[rows].tolist(), ids.tolist(), here.tolist()):
                    if k >= 0:
                        out[r].append(k)
                    else:
                        out[r] += self.byte_ids[list(words[r][e - 1].encode("utf-8", "replace"))].tolist()
        return out, score

    def marginal(self, words: list[str]) -> np.ndarray:
        """Log probability of each word over all its segmentations, by forward recursion in log space."""
        out = np.zeros(len(words))
        for part, size, chars in self._slabs(words):
            alpha = self._forward(size, chars, self._arcs(size, chars))
            out[part] = alpha[np.arange(len(part)), size]
        return out

    def _forward(self, size, chars, arcs):
        alpha = np.full((len(size), chars.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for i, n, rows, ids in arcs:
            alpha[rows, i + n] = np.logaddexp(alpha[rows, i + n], alpha[rows, i] + self._weight(chars, i, rows, ids))
        return alpha

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``words`` that occur ``counts`` times, by forward-backward."""
        out = np.zeros(len(self.pieces))
        counts = np.asarray(counts, np.float64)
        for part, size, chars in self._slabs(words):
            arcs = list(self._arcs(size, chars))
            alpha = self._forward(size, chars, arcs)
            total = alpha[np.arange(len(part)), size]
            beta = np.full(alpha.shape, -np.inf)
            beta[np.arange(len(part)), size] = 0
            for i, n, rows, ids in reversed(arcs):
                w = self._weight(chars, i, rows, ids)
                beta[rows, i] = np.logaddexp(beta[rows, i], w + beta[rows, i + n])
                share = np.exp(alpha[rows, i] + w + beta[rows, i + n] - total[rows]) * counts[part[rows]]
                if ids is None:
                    for c, x in zip(chars[rows, i].tolist(), share.tolist()):
                        np.add.at(out, self.byte_ids[list(chr(c).encode("utf-8", "replace"))], x)
                else:
                    out += np.bincount(ids, share, minlength=len(out))
        return out


def unigram_logp(score: np.ndarray, usable: np.ndarray, byte_ids: np.ndarray) -> np.ndarray:
    """Normalised log probabilities from a vocabulary's scores: ranks by Zipf's law, else as they are."""
    s = score[usable]
    ranks = len(s) and bool((s <= 0).all() and (s == np.round(s)).all() and len(np.unique(s)) == len(s))
    weight = np.zeros(len(score))
    if ranks:
        order = np.argsort(-s, kind="stable")
        rank = np.empty(len(s))
        rank[order] = np.arange(1, len(s) + 1)
        weight[usable] = 1 / rank
    else:
        weight[usable] = np.exp(s)
    if len(byte_ids):
        weight[byte_ids] = weight[usable].min() if usable.any() else 1.0
    with np.errstate(divide="ignore"):
        return np.log(weight / weight.sum())


def marked(word: str) -> str:
    """A word with the white-space marker in front."""
    return MARK + word

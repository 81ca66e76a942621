"""Language-model scoring with causal self-attention over subword ids, in numpy.

Counting.  Texts are taken in blocks of a few megabytes; a block's distinct words are coded
once.  Word counts of all training texts are summed over the cluster, and the counts of a
block's words come back to the block by a join on the word, so no vocabulary is ever broadcast.

Model.  Words become ids of a public byte-level vocabulary.  Inside a word, attention over the
last REACH ids gives what follows: an id, or the end of the word.  Over the words of a text,
attention gives shares of TOPICS topics.  A topic has its own law of a word's first id and tilts
the outputs inside words, and a word's probability is the topics' mixture of the products over
its ids.  What happens inside a word depends on the word alone, so it is computed once for each
distinct word of a block; only the attention over words runs at every word of every text.

Training.  A bounded share of the training texts trains the first weights in one task.  What happens
inside words is then trained on the corpus's distinct words, each once with its count, and the
attention over words on all other training texts.  Either trains copies, one for each partition,
which are averaged in a tree.

Scoring.  A text is cut into overlapping windows: CONTEXT words of context, then STRIDE words that
this window scores, so each id is scored once.  Windows are scored in batches under one mask.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.bpe import codec
from foliomill.llm.common import give_back, id_crc32, shuffle_partitions, sub_batches, text_or_empty, tokenizer_path, written
from foliomill.llm.packing import has_long_blank, token_encoder

CONTEXT, STRIDE = 8, 24
WIDTH, HIDDEN = 16, 24
TOPICS = 8
DEEP, DEEP_HIDDEN, REACH = 16, 40, 3
#: Outputs for a word's first id, for what follows inside words, and how many of either are shared by rare ids.
FIRSTS, INNERS, TAIL = 768, 768, 64
#: Input rows; below 4095, as a place inside a word packs REACH of them into one long.
ROWS = 2048
END = 50_256
SMOOTH = 0.1
BLOCK_BYTES = 12 << 20
WORDS_A_ROW = 4096
#: Words that train the first weights, in one task; a smaller corpus goes through it until about FIRST_STEPS words or eight passes.
FIRST_WORDS, FIRST_STEPS = 400_000, 800_000
#: Words of a partition that train a copy, at least; text that a copy learns from at a time, in the first weights and after.
PART_WORDS = 250_000
#: Distinct words of a partition that trains a copy of what happens inside words, at least, and of a block of them.
PART_DISTINCT, DISTINCT = 400_000, 200_000
#: Places inside words that are in every batch of these.
HEAVY = 256
#: Words with at least this part of all words are in every block of distinct words; there are no more of them than this.
FREQUENT = 16_384
FIRST_BYTES, LEARN_BYTES = 300_000, 4_000_000
FIRST_RATE, RATE = 0.02, 0.008
#: Words that the present law of first ids counts for when a copy goes on from it.
FIRST_MASS = 2000.0
BATCH, NODE_BATCH = 256, 1024


@functools.lru_cache(maxsize=2)
def vocabulary(path: str):
    encoding, _ = token_encoder(path)
    lengths = np.zeros(END + 1, np.int64)
    for i in range(END):
        lengths[i] = len(encoding.decode_single_token_bytes(i))
    return encoding, lengths


def word_ids(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of words, each with a space before it, and the offsets of each word."""
    encoding, lengths = vocabulary(path)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    odd = pc.match_substring_regex(words, r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]").to_numpy(zero_copy_only=False)
    plain = words.filter(pa.array(~odd)) if odd.any() else words
    # A word after a space always begins a pre-token, so all words are encoded in one text and cut by their bytes.
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), " ")[0].as_py()
    ids = encoding.encode_to_numpy(" " + joined, disallowed_special=()).astype(np.int64) if len(plain) else np.zeros(0, np.int64)
    ends = np.cumsum(pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    offsets = np.concatenate([[0], np.searchsorted(np.cumsum(lengths[ids]), ends, side="right")]) if len(plain) else np.zeros(1, np.int64)
    if not odd.any():
        return ids, offsets
    parts, at = [], 0
    for i, is_odd in enumerate(odd.tolist()):
        if is_odd:
            word = " " + words[i].as_py()
            parts.append(np.array(codec(path).encode_plain(word) if has_long_blank(word) else encoding.encode_ordinary(word), np.int64))
        else:
            parts.append(ids[offsets[at] : offsets[at + 1]])
            at += 1
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts with A-Z in lower case, and the text each belongs to."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    return (words, owner) if some.all() else (words.filter(pa.array(some)), owner[some])


# ---- the model


@dataclass
class Kinds:
    """What the outputs of the model stand for, from the corpus counts of ids that begin a word and of those inside words.

    The most frequent ids are outputs of their own; the others share TAIL outputs of about equal
    mass, and inside one an id has its smoothed share.  `row` is an id's input row.
    """

    first: np.ndarray
    first_share: np.ndarray
    inner: np.ndarray
    inner_share: np.ndarray
    row: np.ndarray
    first_prior: np.ndarray
    inner_prior: np.ndarray

    @classmethod
    def from_counts(cls, first: np.ndarray, inner: np.ndarray) -> Kinds:
        """`first` has the ends of texts at END; the ends of words are output 0 of `inner`, as often as there are words."""
        first_of, first_share, first_total = _outputs(first, FIRSTS)
        inner_of, inner_share, inner_total = _outputs(inner, INNERS - 1)
        inner_total = np.concatenate([[first.sum() - first[END] + SMOOTH], inner_total])
        order = np.argsort(-(first + inner), kind="stable")
        row = np.empty(END + 1, np.int64)
        row[order] = np.minimum(np.arange(END + 1), ROWS // 2 - 1)
        tail = order[ROWS // 2 - 1 :]
        row[tail] = ROWS // 2 - 1 + tail % (ROWS // 2)
        return cls(first_of, first_share, inner_of + 1, inner_share, row, np.log(first_total / first_total.sum()).astype(np.float32),
                   np.log(inner_total / inner_total.sum()).astype(np.float32))


def _outputs(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id -> output, log10 of the id's share of its output, and the mass of each output."""
    mass = counts + SMOOTH
    order = np.argsort(-mass, kind="stable")
    of = np.empty(len(mass), np.int64)
    of[order[: n - TAIL]] = np.arange(n - TAIL)
    rest = order[n - TAIL :]
    before = np.cumsum(mass[rest]) - mass[rest]
    of[rest] = n - TAIL + np.minimum((before / mass[rest].sum() * TAIL).astype(np.int64), TAIL - 1)
    total = np.bincount(of, weights=mass, minlength=n)
    return of, np.log10(mass) - np.log10(total[of]), np.maximum(total, 1e-9)


SHAPES = {
    # words in a text: attention gives the mixture of topics
    "head": (ROWS, WIDTH), "end": (ROWS, WIDTH), "places": (CONTEXT + STRIDE, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH),
    "mix": (2 * WIDTH, HIDDEN), "bend": (HIDDEN,), "gate": (HIDDEN, TOPICS), "usual": (TOPICS,),
    # ids in a word: attention gives the next id
    "rows": (ROWS + 1, DEEP), "steps": (REACH, DEEP), "iq": (DEEP, DEEP), "ik": (DEEP, DEEP), "iv": (DEEP, DEEP),
    "imix": (2 * DEEP, DEEP_HIDDEN), "ibend": (DEEP_HIDDEN,), "out": (DEEP_HIDDEN, INNERS), "bias": (INNERS,), "tilt": (TOPICS, INNERS),
    # log probabilities of a word's first id by topic
    "start": (TOPICS, FIRSTS),
    # logarithms of the shares of the topics in all words
    "share": (TOPICS,),
}
OUTER, DEEPER = list(SHAPES)[:10], list(SHAPES)[10:20]
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
ONES = np.ones(TOPICS, np.float32)
#: No exponent is larger, so that sums of exponentials stay finite.
MOST = np.float32(60)
#: Position i of the scored part may look at the inputs before it; places CONTEXT + i on are later.
MASK = np.where(np.arange(CONTEXT + STRIDE)[None, :] <= CONTEXT + np.arange(STRIDE)[:, None], 0.0, -1e9).astype(np.float32)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def first_weights(kinds: Kinds) -> np.ndarray:
    rng = np.random.default_rng(11)
    flat = np.zeros(SIZE, np.float32)
    w = unpack(flat)
    scale = {"head": 0.5, "end": 0.5, "places": 0.3, "rows": 0.5, "steps": 0.3, "tilt": 0.3, "start": 0.5}
    for name, shape in SHAPES.items():
        if len(shape) == 2:
            w[name][...] = rng.normal(0, scale.get(name, shape[0] ** -0.5), shape)
    w["gate"][...] *= 0.3
    w["out"][...] *= 0.3
    w["bias"][...] = kinds.inner_prior
    w["start"][...] += kinds.first_prior
    w["start"][...] -= np.log(np.exp(w["start"]).sum(1, keepdims=True))
    return flat


@dataclass
class Block:
    """Texts as codes into a list of distinct words, and the ids of those words."""

    codes: np.ndarray
    texts: np.ndarray  # where each text's codes begin
    ids: np.ndarray
    words: np.ndarray  # where each word's ids begin

    @property
    def size(self) -> int:
        return len(self.words) - 1


def followers(kinds: Kinds, block: Block) -> np.ndarray:
    """The output that follows each id: 0, the end of the word, unless an id follows."""
    out = np.zeros(len(block.ids), np.int64)
    out[:-1] = kinds.inner[block.ids[1:]]
    out[block.words[1:] - 1] = 0
    return out


class Nodes:
    """The distinct places inside a block's words: up to REACH ids before, and what follows there."""

    def __init__(self, kinds: Kinds, block: Block):
        ids, n = block.ids, len(block.ids)
        at = np.arange(n) - np.repeat(block.words[:-1], np.diff(block.words))
        row = kinds.row[ids]
        key = np.zeros(n, np.int64)
        for back in range(REACH):
            before = np.full(n, ROWS)
            before[back:] = np.where(at[back:] >= back, row[: n - back], ROWS)
            key = key << 12 | before
        target = followers(kinds, block)
        self.order = np.argsort(key)  # steps by their node
        key = key[self.order]
        new = np.append(True, key[1:] != key[:-1])[:n]
        first = np.flatnonzero(new)
        distinct = key[first]
        self.before = np.stack([distinct >> (12 * (REACH - 1 - back)) & 4095 for back in range(REACH)], 1)
        self.node, self.target = np.cumsum(new) - 1, target[self.order]
        self.word = np.repeat(np.arange(block.size), np.diff(block.words))[self.order]
        self.edges = np.append(first, n)

    def __len__(self) -> int:
        return len(self.before)

    def merge(self, amounts: np.ndarray) -> np.ndarray:
        """Put steps of equal node and target together; returns the sums of their words' amounts."""
        order = np.argsort(self.node * INNERS + self.target, kind="stable")
        node, target = self.node[order], self.target[order]
        first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (target[1:] != target[:-1])))
        out = np.add.reduceat(amounts[self.word[order]], first, axis=0)
        self.node, self.target, self.word = node[first], target[first], np.arange(len(first))
        self.edges = np.searchsorted(self.node, np.arange(len(self) + 1))
        return out

    def slices(self, step: int = 512):
        """(nodes, steps) of about `step` nodes."""
        for a in range(0, len(self), step):
            b = min(a + step, len(self))
            yield slice(a, b), slice(int(self.edges[a]), int(self.edges[b]))


def inner_forward(w: dict[str, np.ndarray], before: np.ndarray):
    """Attention of the last id of each place over the ids before it; logits of what follows."""
    x = np.take(w["rows"], before, axis=0)
    x += w["steps"]
    q = x[:, 0] @ w["iq"]
    both = x.reshape(-1, DEEP) @ np.concatenate([w["ik"], w["iv"]], 1)
    k, v = both[:, :DEEP].reshape(x.shape), both[:, DEEP:].reshape(x.shape)
    s = np.matmul(k, q[:, :, None])[:, :, 0] * np.float32(DEEP**-0.5)
    s[before == ROWS] = -1e9
    s -= s.max(1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(1, keepdims=True)
    seen = np.matmul(s[:, None, :], v)[:, 0]
    both = np.concatenate([x[:, 0], seen], 1)
    h = np.ones((len(x), DEEP_HIDDEN + 1), x.dtype)  # the last column takes the bias
    np.tanh(both @ w["imix"] + w["ibend"], out=h[:, :-1])
    return h @ _with_bias(w), (x, q, k, v, s, both, h)


def _with_bias(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w["out"], w["bias"][None, :]])


def _lowered(w: dict[str, np.ndarray], logits: np.ndarray) -> None:
    """Take each row's maximum from logits in place, unless no place at all can have a logit whose exponential is too large."""
    if (np.abs(w["out"]).sum(0) + np.abs(w["bias"])).max() > MOST:
        logits -= logits.max(1, keepdims=True)


def word_scores(w: dict[str, np.ndarray], kinds: Kinds, block: Block, nodes: Nodes) -> np.ndarray:
    """Natural log probability of each word under each topic (words, TOPICS); the last row is the end of a text."""
    tilt, own_tilt, by_step = np.exp(w["tilt"]).T.copy(), w["tilt"].T.copy(), np.empty((len(block.ids), TOPICS), np.float32)
    for some, steps in nodes.slices():
        logits, _ = inner_forward(w, nodes.before[some])
        _lowered(w, logits)
        own, target = nodes.node[steps] - some.start, nodes.target[steps]
        value = np.take(own_tilt, target, axis=0)
        value += logits[own, target][:, None]
        value -= np.log(np.exp(logits, out=logits) @ tilt)[own]
        by_step[nodes.order[steps]] = value
    out = np.empty((block.size + 1, TOPICS), np.float32)
    if block.size:
        out[:-1] = np.add.reduceat(by_step, block.words[:-1], axis=0)
        out[:-1] += w["start"].T[kinds.first[block.ids[block.words[:-1]]]]
    out[-1] = w["start"][:, kinds.first[END]]
    return out


def shares(kinds: Kinds, block: Block) -> np.ndarray:
    """log10 of the shares of each word's ids in their outputs; the last entry is the end of a text."""
    if not block.size:
        return kinds.first_share[[END]]
    per_id = kinds.inner_share[block.ids]
    per_id[block.words[:-1]] = kinds.first_share[block.ids[block.words[:-1]]]
    return np.append(np.add.reduceat(per_id, block.words[:-1]), kinds.first_share[END])


class Windows:
    """The windows of texts (codes and offsets): inputs of CONTEXT + STRIDE places, and STRIDE targets.

    The sequence of a text is `end`, its words, `end`; input j predicts target j + 1.  Places
    before the sequence hold `end` as well; targets beyond it are -1.
    """

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, end: int):
        lengths = np.diff(offsets) + 1  # targets: the words and the last end
        per = -(-lengths // STRIDE)
        self.text = np.repeat(np.arange(len(lengths)), per)
        self.first = (np.arange(len(self.text)) - np.repeat(np.cumsum(per) - per, per)) * STRIDE
        self.base, self.size = offsets[:-1], lengths
        self.padded = np.append(codes, end)

    def __len__(self) -> int:
        return len(self.text)

    def take(self, pick) -> tuple[np.ndarray, np.ndarray]:
        text, last = self.text[pick], len(self.padded) - 1
        base, size = self.base[text][:, None], self.size[text][:, None]
        place = self.first[pick][:, None] + np.arange(-CONTEXT - 1, STRIDE - 1)[None, :]
        inputs = self.padded[np.where((place >= 0) & (place < size - 1), base + place, last)]
        place = place[:, CONTEXT:] + 1
        targets = np.where(place < size, self.padded[np.where(place < size - 1, base + place, last)], -1)
        return inputs, targets


def ends_of(kinds: Kinds, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Input rows of the first and the last id of each word, and of the end."""
    if not block.size:
        return (kinds.row[[END]],) * 2
    return np.append(kinds.row[block.ids[block.words[:-1]]], kinds.row[END]), np.append(kinds.row[block.ids[block.words[1:] - 1]], kinds.row[END])


def joined(w: dict[str, np.ndarray]) -> np.ndarray:
    """The weights that a place is multiplied by: of its query, its key, its value and its own part of the hidden layer."""
    return np.concatenate([w["q"] * np.float32(WIDTH**-0.5), w["k"], w["v"], w["mix"][:WIDTH]], 1)


def forward(w: dict[str, np.ndarray], vectors: np.ndarray, inputs: np.ndarray, keep: bool = False):
    """Shares of the topics, up to a factor, at the scored places of each window, (n * STRIDE, TOPICS)."""
    x = np.take(vectors, inputs, axis=0)
    x += w["places"]
    wide = (x.reshape(-1, WIDTH) @ joined(w)).reshape(len(x), CONTEXT + STRIDE, -1)
    q, k, v = wide[:, CONTEXT:, :WIDTH], wide[:, :, WIDTH : 2 * WIDTH], wide[:, :, 2 * WIDTH : 3 * WIDTH]
    s = q @ k.transpose(0, 2, 1)
    np.minimum(s, MOST, out=s)
    s += MASK
    np.exp(s, out=s)
    # Sums are divided, and not the exponentials, of which there are more.
    total = (s.reshape(-1, s.shape[2]) @ np.ones(s.shape[2], s.dtype))[:, None]
    seen = (s @ v).reshape(-1, WIDTH)
    seen /= total
    h = seen @ w["mix"][WIDTH:]
    h.reshape(len(x), STRIDE, HIDDEN)[...] += wide[:, CONTEXT:, 3 * WIDTH :]
    h += w["bend"]
    np.tanh(h, out=h)
    raised = h @ w["gate"]
    raised += w["usual"]
    np.minimum(raised, MOST, out=raised)
    np.exp(raised, out=raised)
    return (raised, (x, q, k, v, s, total, seen, h)) if keep else raised


def odds_of(by_topic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's probabilities by topic against the greatest of them, and the logarithm of that."""
    top = by_topic.max(1)
    return np.exp(by_topic - top[:, None]), top


class Scorer:
    """Scores texts over one list of distinct words."""

    def __init__(self, flat: np.ndarray, kinds: Kinds, ids: np.ndarray, words: np.ndarray):
        none = Block(np.zeros(0, np.int64), np.zeros(1, np.int64), ids, words)
        self.w, self.end = unpack(flat), none.size
        self.odds, top = odds_of(word_scores(self.w, kinds, none, Nodes(kinds, none)))
        self.known = top / np.log(10) + shares(kinds, none)
        head, last = ends_of(kinds, none)
        self.vectors = self.w["head"][head] + self.w["end"][last]

    def log10(self, codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """log10 probability of each text (its words' ids and the end after them), each id scored once."""
        windows, out = Windows(codes, texts, self.end), np.zeros(len(texts) - 1)
        for at in range(0, len(windows), BATCH):
            inputs, targets = windows.take(slice(at, at + BATCH))
            target = targets.reshape(-1)
            raised = forward(self.w, self.vectors, inputs)
            total = raised @ ONES
            raised *= self.odds[target]
            value = np.log10(np.maximum(raised @ ONES, 1e-37) / total)
            value = (value + self.known[target]) * (target >= 0)
            out += np.bincount(windows.text[at : at + BATCH], weights=value.reshape(-1, STRIDE).sum(1, dtype=np.float64), minlength=len(out))
        return out


class Adam:
    """Adam's moments for some of the weights."""

    def __init__(self, names: list[str]):
        self.names, self.step = names, 0
        self.m, self.v = ({n: np.zeros(SHAPES[n], np.float32) for n in names} for _ in range(2))

    def apply(self, w: dict[str, np.ndarray], grad: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        a, b = rate / (1 - 0.9**self.step), 1 / (1 - 0.99**self.step)
        for n in self.names:
            m, v, g = self.m[n], self.v[n], grad[n]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            w[n] -= np.float32(a) * m / (np.sqrt(v * np.float32(b)) + np.float32(1e-8))


class Trainer:
    """A copy of the weights that goes from block to block.

    Of a block, what tells the topics of its words apart comes first; then the attention over
    words is trained on all its windows and says how much of each word falls to which topic; with
    those amounts the attention inside words, the tilts and the first ids are trained.
    """

    def __init__(self, flat: np.ndarray, kinds: Kinds, seed: int = 0, batch: int = 96):
        self.flat, self.kinds, self.rng, self.batch = flat.copy(), kinds, np.random.default_rng(seed), batch
        self.w = unpack(self.flat)
        self.outer, self.deeper = Adam(OUTER), Adam(DEEPER)
        self.firsts = np.exp(self.w["start"]).astype(np.float64) * FIRST_MASS

    def learn(self, block: Block, rate: float, inside: bool = True) -> None:
        """Learn from the texts of a block; `inside` as well as over words."""
        amounts = self._outer_pass(block, self._topic_scores(block), rate)
        if inside:
            self._inner_pass(Nodes(self.kinds, block), amounts[:-1], rate)
        self.w["share"][...] = np.log(amounts.sum(0) + 1) - np.log((amounts.sum(0) + 1).sum())
        for z in range(TOPICS):
            if block.size:
                self.firsts[z] += np.bincount(self.kinds.first[block.ids[block.words[:-1]]], weights=amounts[:-1, z], minlength=FIRSTS)
            self.firsts[z, self.kinds.first[END]] += amounts[-1, z]
        self.w["start"][...] = np.log(self.firsts + 1e-6) - np.log((self.firsts + 1e-6).sum(1, keepdims=True))

    def learn_inside(self, words: Block, counts: np.ndarray, rate: float) -> None:
        """Learn what happens inside distinct words; each falls to the topics by what tells them apart and their shares."""
        odds, _ = odds_of(self._topic_scores(words)[:-1] + self.w["share"])
        odds *= (counts / odds.sum(1))[:, None].astype(np.float32)
        nodes = Nodes(self.kinds, words)
        amounts = nodes.merge(odds)
        # The places that most words pass are in every batch with an equal part of their amounts, else one batch's would outweigh all others'.
        turns = -(-len(nodes) // NODE_BATCH)
        mass = np.add.reduceat(amounts.sum(1), nodes.edges[:-1])
        heavy = np.sort(np.argsort(-mass, kind="stable")[:HEAVY])
        light = np.delete(np.arange(len(nodes)), heavy)
        amounts[np.isin(nodes.node, heavy)] /= turns
        for begin in self.rng.permutation(turns).tolist():
            some = np.sort(np.concatenate([heavy, light[begin::turns]]))
            self.deeper.apply(self.w, inner_gradient(self.w, nodes, some, amounts), rate)

    def _topic_scores(self, block: Block) -> np.ndarray:
        """What tells the topics of each word (and of the end) apart: its first id, and the tilts of what follows."""
        out = np.zeros((block.size + 1, TOPICS), np.float32)
        if block.size:
            tilt = self.w["tilt"] - np.log(np.exp(self.w["tilt"] + self.kinds.inner_prior).sum(1, keepdims=True))
            out[:-1] = np.add.reduceat(tilt.T[followers(self.kinds, block)], block.words[:-1], axis=0)
            out[:-1] += self.w["start"].T[self.kinds.first[block.ids[block.words[:-1]]]]
        out[-1] = self.w["start"][:, self.kinds.first[END]]
        return out

    def _outer_pass(self, block: Block, by_topic: np.ndarray, rate: float) -> np.ndarray:
        """Train on all windows; returns how much of each word (and of the end) each topic takes."""
        head, end = ends_of(self.kinds, block)
        odds, _ = odds_of(by_topic)
        held = []
        windows = Windows(block.codes, block.texts, block.size)
        order = self.rng.permutation(len(windows))
        for at in range(0, len(order), self.batch):
            grad, target, share = outer_gradient(self.w, head, end, *windows.take(order[at : at + self.batch]), odds)
            self.outer.apply(self.w, grad, rate)
            held.append((target, share))
        target, share = (np.concatenate(part) for part in zip(*held))
        return np.stack([np.bincount(target, weights=share[:, z], minlength=block.size + 1) for z in range(TOPICS)], 1)

    def _inner_pass(self, nodes: Nodes, amounts: np.ndarray, rate: float) -> None:
        for begin in self.rng.permutation(-(-len(nodes) // NODE_BATCH)).tolist():
            # every so many-th node, so that each batch has nodes of all kinds
            some = np.arange(begin, len(nodes), -(-len(nodes) // NODE_BATCH))
            self.deeper.apply(self.w, inner_gradient(self.w, nodes, some, amounts), rate)


def inner_gradient(w: dict[str, np.ndarray], nodes: Nodes, some: np.ndarray, amounts: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean negative log probability of what follows at some nodes, by the topics' amounts."""
    per = nodes.edges[some + 1] - nodes.edges[some]
    begins = np.cumsum(per) - per
    steps = np.repeat(nodes.edges[some] - begins, per) + np.arange(per.sum())
    target, weight = nodes.target[steps], np.take(amounts, nodes.word[steps], axis=0).astype(np.float32, copy=False)
    weight /= max(float(weight.sum()), 1e-6)
    before, tilt = nodes.before[some], np.exp(w["tilt"])
    p, (x, q, k, v, s, both, h) = inner_forward(w, before)
    _lowered(w, p)
    np.exp(p, out=p)
    mass = np.add.reduceat(weight, begins, axis=0) / (p @ tilt.T)
    grad = {"tilt": tilt * (mass.T @ p)}
    of_topic = target[:, None] + INNERS * np.arange(TOPICS)
    np.subtract.at(grad["tilt"].reshape(-1), of_topic.reshape(-1), weight.reshape(-1))
    p *= mass @ tilt
    np.subtract.at(p.reshape(-1), np.repeat(np.arange(len(some)) * INNERS, per) + target, weight @ ONES)
    with_bias = h.T @ p
    grad["out"], grad["bias"], h = with_bias[:-1], with_bias[-1], h[:, :-1]
    dz = (p @ w["out"].T) * (1 - h * h)
    grad["imix"], grad["ibend"] = both.T @ dz, dz.sum(0)
    dboth = dz @ w["imix"].T
    dx = np.zeros_like(x)
    dx[:, 0] = dboth[:, :DEEP]
    dseen = dboth[:, DEEP:]
    d = np.empty((*x.shape[:2], 2 * DEEP), x.dtype)  # of keys and values
    d[:, :, DEEP:] = s[:, :, None] * dseen[:, None, :]
    ds = np.matmul(v, dseen[:, :, None])[:, :, 0]
    ds = s * (ds - (ds * s).sum(1, keepdims=True)) * np.float32(DEEP**-0.5)
    dq = np.matmul(ds[:, None, :], k)[:, 0]
    d[:, :, :DEEP] = ds[:, :, None] * q[:, None, :]
    d = d.reshape(-1, 2 * DEEP)
    grad["iq"], by_place = x[:, 0].T @ dq, x.reshape(-1, DEEP).T @ d
    grad["ik"], grad["iv"] = by_place[:, :DEEP], by_place[:, DEEP:]
    dx[:, 0] += dq @ w["iq"].T
    dx = dx.reshape(-1, DEEP)
    dx += d @ np.concatenate([w["ik"], w["iv"]], 1).T
    grad["steps"] = dx.reshape(x.shape).sum(0)
    grad["rows"] = _row_sums(before.reshape(-1), dx, ROWS + 1)
    return grad


def outer_gradient(w, head: np.ndarray, end: np.ndarray, inputs: np.ndarray, targets: np.ndarray, odds: np.ndarray):
    """Gradient of the mean negative log probability of the windows' words; their codes and their shares by topic."""
    wide, target, places = joined(w), targets.reshape(-1), (np.take(head, inputs).reshape(-1), np.take(end, inputs).reshape(-1))
    vectors = np.take(w["head"], places[0], axis=0)
    vectors += np.take(w["end"], places[1], axis=0)
    raised, (x, q, k, v, s, total, seen, h) = forward(w, vectors, np.arange(inputs.size).reshape(inputs.shape), keep=True)
    real = (target >= 0).astype(np.float32)
    share = np.take(odds, target, axis=0, mode="wrap")
    share *= raised
    share *= (real / np.maximum(share @ ONES, 1e-37))[:, None]
    p = raised
    p *= (real / (p @ ONES))[:, None]
    p -= share
    p /= np.float32(max(1, real.sum()))
    ones = np.ones(len(p), p.dtype)
    g = {"gate": h.T @ p, "usual": ones @ p}
    dz = p @ w["gate"].T
    h *= h
    dz *= 1 - h
    mix, g["bend"] = seen.T @ dz, ones @ dz
    d = np.empty((len(x), CONTEXT + STRIDE, 3 * WIDTH + HIDDEN), x.dtype)  # of queries, keys, values and the hidden layer
    d[:, :CONTEXT, :WIDTH] = d[:, :CONTEXT, 3 * WIDTH :] = 0
    d[:, CONTEXT:, 3 * WIDTH :] = dz.reshape(len(x), STRIDE, HIDDEN)
    dseen = dz @ w["mix"][WIDTH:].T
    dseen /= total
    mean = np.einsum("ij,ij->i", dseen, seen).reshape(len(x), STRIDE, 1)
    dseen = dseen.reshape(len(x), STRIDE, WIDTH)
    np.matmul(s.transpose(0, 2, 1), dseen, out=d[:, :, 2 * WIDTH : 3 * WIDTH])
    ds = dseen @ v.transpose(0, 2, 1)
    ds -= mean
    ds *= s
    np.matmul(ds, k, out=d[:, CONTEXT:, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=d[:, :, WIDTH : 2 * WIDTH])
    d = d.reshape(-1, d.shape[2])
    by_place, dx = x.reshape(-1, WIDTH).T @ d, d @ wide.T
    g["q"], g["k"], g["v"] = by_place[:, :WIDTH] * np.float32(WIDTH**-0.5), by_place[:, WIDTH : 2 * WIDTH], by_place[:, 2 * WIDTH : 3 * WIDTH]
    g["mix"] = np.concatenate([by_place[:, 3 * WIDTH :], mix])
    g["places"] = dx.reshape(x.shape).sum(0)
    g["head"], g["end"] = (_row_sums(rows, dx, ROWS) for rows in places)
    return g, np.maximum(target, 0), share


def _row_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the float32 rows of `values` by their number; two floats are added as one complex number, as numpy has no quicker way."""
    half = values.shape[1] // 2
    out = np.zeros(n * half, np.complex64)
    np.add.at(out, (rows[:, None] * half + np.arange(half)).reshape(-1), values.view(np.complex64).reshape(-1))
    return out.view(np.float32).reshape(n, -1)


# ---- over the cluster


def block_name(partition: int, number: int) -> int:
    """The number of a block: 2^31 partitions with 2^32 blocks each have names of their own."""
    return partition << 32 | number


def coded_blocks(docs: DataFrame, id_col: str, text_col: str, folds: int) -> DataFrame:
    """Texts as codes into their block's words (kind 0), and the words themselves (kind 1).

    Word rows hold up to WORDS_A_ROW words and how often the block's training texts have each.
    """
    schema = "kind int, block long, start int, id_json string, held_out boolean, codes array<int>, words array<string>, trained array<long>"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]

    def batch_of(**columns):
        n = len(columns["block"])
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names)

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in sub_batches(whole, 2, BLOCK_BYTES):
                words, owner = split_words(batch.column(2))
                coded = words.dictionary_encode()
                codes, distinct = coded.indices.to_numpy(), coded.dictionary
                held = batch.column(1).to_numpy(zero_copy_only=False)
                trained = np.bincount(codes[~held[owner]], minlength=len(distinct)) if len(codes) else np.zeros(0, np.int64)
                name, n = block_name(part, number), batch.num_rows
                number += 1
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
                for a in range(0, len(distinct), 16 * WORDS_A_ROW):
                    cuts = np.minimum(np.arange(a, min(a + 16 * WORDS_A_ROW, len(distinct)) + WORDS_A_ROW, WORDS_A_ROW), min(a + 16 * WORDS_A_ROW, len(distinct)))
                    cuts = np.unique(cuts)
                    k = len(cuts) - 1
                    span, rel = slice(int(cuts[0]), int(cuts[-1])), pa.array(cuts - cuts[0], pa.int32())
                    yield batch_of(
                        kind=pa.array([1] * k, pa.int32()), block=pa.array([name] * k, pa.int64()), start=pa.array(cuts[:-1], pa.int32()),
                        words=pa.ListArray.from_arrays(rel, distinct[span]), trained=pa.ListArray.from_arrays(rel, pa.array(trained[span], pa.int64())))
                for a in range(0, n, 256):
                    b = min(a + 256, n)
                    lists = pa.ListArray.from_arrays(pa.array(offsets[a : b + 1] - offsets[a], pa.int32()), pa.array(codes[offsets[a] : offsets[b]], pa.int32()))
                    yield batch_of(kind=pa.array([0] * (b - a), pa.int32()), block=pa.array([name] * (b - a), pa.int64()), id_json=batch.column(0).slice(a, b - a),
                                   held_out=batch.column(1).slice(a, b - a), codes=lists)

    source = docs.select(
        F.to_json(F.struct(F.col(f"`{id_col}`").alias("id"))).alias("id_json"), (id_crc32(id_col) % folds == 0).alias("held_out"),
        text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    return written(source.mapInArrow(run, schema), "coded-blocks", partition_by=["kind"])


def subword_counts(counts: DataFrame, path: str, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """How often the training texts have each subword id as a word's first and inside words; END once for each text."""

    def run(batches):
        total = np.zeros(2 * (END + 1), np.int64)
        for batch in batches:
            ids, offsets = word_ids(batch.column(0), path)
            inside = np.ones(len(ids), np.int64)
            inside[offsets[:-1]] = 0
            times = np.repeat(batch.column(1).to_numpy(), np.diff(offsets))
            total += np.bincount(ids + inside * (END + 1), weights=times, minlength=len(total)).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    out = np.zeros(2 * (END + 1))
    for row in counts.select("word", "c").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]  # at most two rows for each id of the vocabulary
    out[END] += texts
    return out[: END + 1], out[END + 1 :]


def train(docs: DataFrame, kinds: Kinds, id_col: str, text_col: str, folds: int, path: str, words: int, counts: DataFrame | None = None, distinct: int = 0) -> np.ndarray:
    """Weights trained on all training texts; `words` is how many words and ends they have.

    A share of the texts, by a hash of the id, of about FIRST_WORDS words trains the first weights
    in one task.  With `counts` (word, c) of all training texts, `distinct` rows, each partition of
    these trains a copy of what happens inside words; else the texts do.  Then each partition of
    all other texts trains a copy on its texts.  Copies are averaged by their words, sixteen at a
    time, until sixteen or fewer reach the driver.
    """
    spark = docs.sparkSession
    learnt = docs.where(id_crc32(id_col) % folds != 0).select(
        text_or_empty(F.col(f"`{text_col}`")).alias("text"), F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.lit(1 << 40)).alias("_hash"))
    flat, cut = first_weights(kinds), int(min(1.0, FIRST_WORDS / max(1, words)) * (1 << 40))
    if cut == 1 << 40:
        first, others = learnt, None
    else:
        first, others = learnt.where(F.col("_hash") < cut), learnt.where(F.col("_hash") >= cut)
    passes = max(1, min(8, -(-FIRST_STEPS // max(1, min(words, FIRST_WORDS)))))
    flat = _mean_weights(first.select("text").repartition(1), flat, kinds, path, FIRST_BYTES, FIRST_RATE, passes, 96)
    if others is not None:
        if counts is not None:
            flat = _mean_inside(counts, distinct, flat, kinds, path)
        parts = others.select("text").coalesce(max(1, (words - FIRST_WORDS) // PART_WORDS))
        flat = _mean_weights(parts, flat, kinds, path, LEARN_BYTES, RATE, 1, 320, counts is None)
    return flat


def _mean_weights(texts: DataFrame, flat: np.ndarray, kinds: Kinds, path: str, size: int, rate: float, passes: int, windows: int, inside: bool = True) -> np.ndarray:
    """The mean of the copies of `flat` that the partitions of `texts` train, by their words."""
    shared = texts.sparkSession.sparkContext.broadcast((flat, kinds))  # of a fixed size

    def local(batches):
        part, (start, outputs) = TaskContext.get().partitionId(), shared.value
        trainer, seen, held = Trainer(start, outputs, part % 97, windows), 0, []
        for block in text_blocks(batches, path, size):
            trainer.learn(block, rate, inside)
            seen += len(block.codes) + len(block.texts) - 1
            if passes > 1:  # the first weights alone, of a bounded number of words
                held.append(block)
        for turn in range(1, passes):
            for block in held:
                trainer.learn(block, rate * 0.5**turn if turn < 4 else rate / 8)
        del held
        give_back()
        if seen:
            yield _copy(part, trainer, seen)

    return _mean_of(texts.mapInArrow(local, COPY), flat)


def _mean_inside(counts: DataFrame, distinct: int, flat: np.ndarray, kinds: Kinds, path: str) -> np.ndarray:
    """The mean of the copies of `flat` that the partitions of `counts` train inside words, by their words.

    A frequent word is in every block with a part of its count, so that the blocks are alike.
    """
    total, frequent, rare = counts.agg(F.sum("c")).first()[0], [], counts.select("word", "c")
    if distinct > FREQUENT:  # so some are rarer
        is_rare = F.col("c") * FREQUENT < total
        frequent, rare = counts.where(~is_rare).select("word", "c").collect(), rare.where(is_rare)  # at most FREQUENT
    often = pa.array([r["word"] for r in frequent], pa.string()), np.array([r["c"] for r in frequent], np.float64)
    shared = counts.sparkSession.sparkContext.broadcast((flat, kinds, *often, float(total - often[1].sum())))  # of a fixed size

    def local(batches):
        part, (start, outputs, also, also_times, mass) = TaskContext.get().partitionId(), shared.value
        trainer, seen = Trainer(start, outputs, part % 97), 0
        for words, times in word_blocks(batches):
            whole = pa.concat_arrays([also, words.cast(pa.string())])
            trainer.learn_inside(Block(np.zeros(0, np.int64), np.zeros(1, np.int64), *word_ids(whole, path)), np.append(also_times * (times.sum() / mass), times), RATE)
            seen += int(times.sum())
        give_back()
        if seen:
            yield _copy(part, trainer, seen)

    return _mean_of(rare.coalesce(max(1, distinct // PART_DISTINCT)).mapInArrow(local, COPY), flat)


def word_blocks(batches) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words and their counts, DISTINCT words at a time; the last may be fewer."""
    words, times, n = [], [], 0
    for batch in batches:
        words.append(batch.column(0))
        times.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n >= DISTINCT:
            yield pa.concat_arrays(words), np.concatenate(times)
            words, times, n = [], [], 0
    if n:
        yield pa.concat_arrays(words), np.concatenate(times)


def _copy(part: int, trainer: Trainer, seen: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([trainer.flat.tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["part", "weights", "words"])


def _mean_of(copies: DataFrame, flat: np.ndarray) -> np.ndarray:
    copies = written(copies, "weights")
    while copies.count() > 16:
        copies = written(copies.withColumn("part", F.floor(F.col("part") / 16).cast("int")).groupBy("part").applyInArrow(_mean, COPY), "weights")
    rows = copies.collect()
    return _average([(np.frombuffer(r["weights"], np.float32), r["words"]) for r in rows]) if rows else flat


COPY = "part int, weights binary, words long"


def text_blocks(batches, path: str, size: int) -> Iterator[Block]:
    """Texts as blocks of about `size` bytes, or one longer text."""
    held, n = [], 0
    for whole in batches:
        for batch in sub_batches(whole, 0, size):
            held.append(batch.column(0))
            n += batch.column(0).nbytes
            if n >= size:
                yield as_block(pa.concat_arrays(held), path)
                held, n = [], 0
    if held:
        yield as_block(pa.concat_arrays(held), path)


def as_block(texts: pa.Array, path: str) -> Block:
    words, owner = split_words(texts)
    coded = words.dictionary_encode()
    ids, offsets = word_ids(coded.dictionary, path)
    per = np.bincount(owner, minlength=len(texts))
    return Block(coded.indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(per)]).astype(np.int64), ids, offsets.astype(np.int64))


def _average(copies: list[tuple[np.ndarray, int]]) -> np.ndarray:
    total = sum(n for _, n in copies)
    return sum(w.astype(np.float64) * (n / total) for w, n in copies).astype(np.float32)


def _mean(key, table):
    copies = [(np.frombuffer(w, np.float32), n) for w, n in zip(table.column("weights").to_pylist(), table.column("words").to_pylist())]
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([_average(copies).tobytes()], pa.binary()), "words": pa.array([sum(n for _, n in copies)], pa.int64())})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, path: str | None = None) -> DataFrame:
    """Score every whole text by corpus counts (base_score) and by the attention model (score).

    Learns from texts whose id's crc32 mod `folds` is not 0.  Null texts count as empty: one
    token, the end.  Repeated rows count and are scored each for itself; a null id counts as the
    empty text under crc32.  An empty table gives an empty result.
    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    id_type = docs.select(F.col(f"`{id_col}`")).schema[0].dataType
    coded = coded_blocks(docs, id_col, text_col, folds)
    texts = coded.where("kind = 0").select("block", "id_json", "held_out", "codes")
    words = coded.where("kind = 1").select("block", "start", F.posexplode(F.arrays_zip("words", "trained")).alias("at", "w")).select(
        "block", (F.col("start") + F.col("at")).alias("at"), F.col("w.words").alias("word"), F.col("w.trained").alias("trained"))
    counts = written(words.where("trained > 0").groupBy("word").agg(F.sum("trained").alias("c")), "word-counts")
    ends = texts.where(~F.col("held_out")).count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = sums["n"] + ends, sums["v"] + (1 if ends else 0)
    kinds = Kinds.from_counts(*subword_counts(counts, path, ends))
    flat = train(docs, kinds, id_col, text_col, folds, path, n, counts, sums["v"])
    log_total = float(np.log10(n + 0.1 * (v + 1)))
    shared = docs.sparkSession.sparkContext.broadcast((flat, kinds))  # of a fixed size

    # Each word of a block gets its count, and the counts go back to the block's words and texts.
    # Inside a block a long sorts them: counts (0), words (1) and texts (2), then the place.
    nothing = {"at": "array<int>", "c": "array<long>", "words": "array<string>", "id_json": "string", "held_out": "boolean", "codes": "array<int>"}

    def rows(df: DataFrame, kind: int, place: str, have: list[str]) -> DataFrame:
        # Empty lists and not nulls: Arrow's list writer goes over a batch again for each null.
        empty = {c: F.array().cast(t) if t.startswith("array") else F.lit(None).cast(t) for c, t in nothing.items()}
        key = F.lit(kind << 32) + F.expr(place).cast("long")
        return df.select("block", key.alias("key"), *[F.col(c) if c in have else v.alias(c) for c, v in empty.items()])

    def by_block(batches):  # one row for the words of a block that lie in a batch
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            names, at, c = (batch.column(i).to_numpy()[order] for i in range(3))
            first = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
            edges = pa.array(np.append(first, len(names)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(names[first]), pa.ListArray.from_arrays(edges, pa.array(at, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(c))], ["block", "at", "c"])

    # Each word is one row of the counts, so none has much to hold; without the hint a block's words are sorted as strings.
    found = words.select("block", "at", "word").join(counts.withColumnRenamed("word", "_word").hint("shuffle_hash"), F.col("word") == F.col("_word"), "left")
    found = found.select("block", F.col("at").cast("int").alias("at"), F.coalesce("c", F.lit(0)).cast("long").alias("c")).mapInArrow(by_block, "block long, at array<int>, c array<long>")
    found = rows(found, 0, "0", ["at", "c"])
    own = rows(coded.where("kind = 1"), 1, "start", ["words"])
    blocks = texts.select("block").distinct().count()
    parts = max(1, min(3 * blocks, 4 * shuffle_partitions(docs.sparkSession)))  # a partition takes its blocks one after the other
    dealt = (found.unionAll(own).unionAll(rows(texts, 2, "0", ["id_json", "held_out", "codes"]))
             .repartition(parts, "block").sortWithinPartitions("block", "key"))
    out_names = ["id_json", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        weights, outputs = shared.value
        block, held_words, held_counts, ready = None, [], [], None
        for batch in batches:
            names, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy() >> 32
            edges = np.concatenate([[0], np.flatnonzero((np.diff(names) != 0) | (np.diff(keys) != 0)) + 1, [len(keys)]]) if len(keys) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                part, kind = batch.slice(int(a), int(b - a)), int(keys[a])
                if int(names[a]) != block:
                    block, held_words, held_counts, ready = int(names[a]), [], [], None
                if kind == 0:
                    held_counts.append((part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()))
                elif kind == 1:
                    held_words.append(part.column(4).flatten())
                else:
                    if ready is None:
                        ids, offsets = word_ids(pa.concat_arrays(held_words) if held_words else pa.array([], pa.string()), path)
                        c = np.zeros(len(offsets) - 1, np.int64)
                        for at, n in held_counts:
                            c[at] = n
                        held_words, held_counts = [], []
                        ready = (c, np.log10(c + 0.1), Scorer(weights, outputs, ids, offsets.astype(np.int64)))
                    yield _scored(part, *ready)
        ready = None
        give_back()

    def _scored(part, c, logs, scorer):
        lists = part.column(7)
        per = pc.list_value_length(lists).to_numpy().astype(np.int64)
        codes = lists.flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(per)), per)
        known_words = np.bincount(owner, weights=c[codes] > 0, minlength=len(per)).astype(np.int64)
        base = np.bincount(owner, weights=logs[codes], minlength=len(per)) + np.log10(ends + 0.1) - (per + 1) * log_total
        scores = scorer.log10(codes, np.concatenate([[0], np.cumsum(per)]))
        return pa.RecordBatch.from_arrays(
            [part.column(5), part.column(6), pa.array(per + 1), pa.array(known_words + (1 if ends else 0)), pa.array(base), pa.array(scores)], out_names)

    scored = dealt.mapInArrow(run, "id_json string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    restored = F.from_json("id_json", F.lit(f"struct<id:{id_type.simpleString()}>"))["id"].alias(id_col)
    return scored.select(restored, "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")

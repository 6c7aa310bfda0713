"""Main text of web pages: blocks in page order, labelled by a bidirectional LSTM in numpy."""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.llm.text import HASH_KEYS, batches, hash_key

#: pages that the labeller is trained on, at most
FIT_PAGES = 400
#: blocks and bytes of blocks that a drawn page of any size hands to training, at most
FIT_BLOCKS, FIT_BYTES = 120, 250_000
_PATH_DIMS, _MARK_DIMS, _WORD_DIMS, _PLAIN_DIMS, _HIDDEN = 128, 16, 32, 8, 24
_INPUTS = _PATH_DIMS + _MARK_DIMS + _WORD_DIMS + _PLAIN_DIMS

# Fixed values of HTML: elements whose content is no text, that stand alone, that break lines.
_NO_TEXT = set(
    "script style noscript template svg iframe select option button textarea title datalist".split()
)
_RAW = set("script style textarea title iframe noscript template".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img "
    "object audio video canvas map math mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom menclose "
    "msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation".split()
)
# Tag names, class and id words that name what is not the article.
_OUTSIDE = set(
    "nav footer aside form dialog menu ad ads advert advertisement sponsor sponsored promo banner sidebar cookie cookies consent gdpr notice "
    "alert popup modal overlay comment comments reply replies respond discussion disqus share sharing social related recommended newsletter "
    "subscribe signup login search breadcrumb breadcrumbs pagination pager toolbar widget masthead topbar navbar navigation header footnav "
    "copyright legal disclaimer skip tags byline meta".split()
)
_INSIDE = set("article main content post story entry body text prose".split())
# What follows these in a class word, or what stands before those, is a state of the element, not its part.
_HAS = set("has with without no not is hide show".split())
_STATES = set("open closed enabled disabled on off".split())
# Inside these an article is none of the page's.
_SURROUNDINGS = set("comment comments related sidebar aside nav footer form ad ads".split())
#: names of large parts of a page, each with a feature of its own
_MARKS = {
    word: slot
    for slot, words in enumerate(
        "article|main|content|post|story|entry|nav menu|aside sidebar|comment comments|footer|header|form|related|ad ads|dialog|social share".split("|")
    )
    for word in words.split()
}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
# steps times pages that are labelled at once; longer pages go alone, in windows of as many blocks
_CELLS = 4096


def name_words(value: str) -> list[str]:
    """The words of a class, id, role or label that may name a part of the page: none of `has-sidebar` or `comments-open`."""
    out = []
    for token in value.split():
        pieces = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
        pieces = pieces[: next((i for i, piece in enumerate(pieces) if piece in _HAS), len(pieces))]
        out += [] if pieces and pieces[-1] in _STATES else pieces
    return out


class Path:
    """The names of the open elements, from the outside in, as a chain that elements share.

    What features and labels need of a path is kept by element, so that a page of thousands of
    elements that are never closed takes no more than that for each of them.
    """

    __slots__ = ("outer", "names", "count", "weight", "_seen")

    def __init__(self, outer: Path | None, names: tuple[str, ...]):
        self.outer, self.names = outer, names
        self.count = len(names) + (outer.count if outer else 0)
        self.weight = sum(map(len, names)) + (outer.weight if outer else 0)
        self._seen = None

    def words(self) -> tuple[str, ...]:
        chain, at = [], self
        while at is not None:
            chain.append(at.names)
            at = at.outer
        return tuple(name for names in reversed(chain) for name in names)

    def seen(self) -> tuple[np.ndarray, int, bool | None, bool]:
        """Last place of each slot (words count from 1, names of large parts among themselves), number of the
        latter, whether the innermost name that says something is of the article, whether one is of its surroundings."""
        todo, at = [], self
        while at is not None and at._seen is None:
            todo.append(at)
            at = at.outer
        last, marks, inside, outside = at._seen if at else (np.zeros(_PATH_DIMS + _MARK_DIMS, dtype=np.int32), 0, None, False)
        for path in reversed(todo):
            last = last.copy()
            for place, word in enumerate(path.names, path.count - len(path.names) + 1):
                last[_slot(word, _PATH_DIMS)] = place
                if word in _MARKS:
                    marks += 1
                    last[_PATH_DIMS + _MARKS[word]] = marks
                if word in _OUTSIDE or word in _INSIDE and word != "body":
                    inside = word in _INSIDE
                outside = outside or word in _SURROUNDINGS
            path._seen = last, marks, inside, outside
        return self._seen

    def features(self) -> np.ndarray:
        """What path_features gives for its words."""
        last, marks, _, _ = self.seen()
        depth = np.concatenate([0.05 * (self.count - last[:_PATH_DIMS]), 0.2 * (marks - last[_PATH_DIMS:])])
        return np.where(last > 0, 1.0 / (1 + depth), 0.0)


def shared_blocks(page: str | None) -> list[tuple[str, Path, int]]:
    """(text, path, characters in links) of every block with text, in page order.

    A path holds the names of the open elements and the words of their class, id and role, from
    the outside in. Unclosed elements end with their parent, a paragraph or list item also with
    the next one. Character references are decoded, white space becomes one space.
    """
    blocks: list[tuple[str, Path, int]] = []
    # open elements with the path up to each one, and the places of each tag among them
    stack: list[tuple[str, Path]] = []
    places: dict[str, list[int]] = {}
    root = Path(None, ())
    pieces: list[str] = []
    linked = silent = 0
    page = page or ""

    def flush():
        nonlocal pieces, linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                blocks.append((text, stack[-1][1] if stack else root, linked))
        pieces, linked = [], 0

    def last(name: str) -> int:
        return places[name][-1] if places.get(name) else -1

    def cut(at: int):
        nonlocal silent
        while len(stack) > at:
            tag, _ = stack.pop()
            places[tag].pop()
            silent -= tag in _NO_TEXT

    at = 0
    while True:
        found = _TAG.search(page, at)
        raw = page[at : found.start() if found else len(page)]
        if raw and not silent:
            pieces.append(raw)
            if places.get("a"):
                linked += len(raw)
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            place = last(name)
            if place >= 0:
                if any(stack[k][0] not in _INLINE for k in range(place, len(stack))):
                    flush()
                cut(place)
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in _INLINE:
            flush()
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
                scope = {"li": "ul ol menu", "td": "tr", "th": "tr", "tr": "table", "dt": "dl", "dd": "dl"}.get(name, "")
                same = last(name)
                if same > max(map(last, scope.split()), default=-1):
                    cut(same)
        if name in _VOID or found[3].endswith("/"):
            continue
        words = [name]
        # classes of the whole page name none of its parts
        for _, double, single, bare in _NAMES.findall(found[3]) if name not in ("html", "body") else ():
            words += name_words(double or single or bare)
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        path = stack[-1][1] if stack else root
        places.setdefault(name, []).append(len(stack))
        silent += name in _NO_TEXT
        stack.append((name, path if name in _INLINE else Path(path, tuple(words))))
    flush()
    return blocks


def page_blocks(page: str | None) -> list[tuple[str, tuple[str, ...], int]]:
    """The blocks of shared_blocks, each with the words of its path."""
    words: dict[Path, tuple[str, ...]] = {}
    return [(text, words[path] if path in words else words.setdefault(path, path.words()), linked) for text, path, linked in shared_blocks(page)]


def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


def path_features(path: tuple[str, ...]) -> np.ndarray:
    """Hashed words of a path and names of large parts among them, the innermost of each slot with its depth.

    The depth of the latter counts only such names, so that no number of other words hides them.
    """
    out = np.zeros(_PATH_DIMS + _MARK_DIMS)
    marks = 0
    for depth, word in enumerate(reversed(path)):
        slot = _slot(word, _PATH_DIMS)
        out[slot] = max(out[slot], 1.0 / (1 + 0.05 * depth))
        if word in _MARKS:
            slot = _PATH_DIMS + _MARKS[word]
            out[slot] = max(out[slot], 1.0 / (1 + 0.2 * marks))
            marks += 1
    return out


def text_features(text: str, linked: int) -> np.ndarray:
    """Hashed words and plain numbers of a block by its text; its two places in the page stay 0."""
    out = np.zeros(_WORD_DIMS + _PLAIN_DIMS)
    words = text.split()
    for word in words:
        out[_slot(word.lower(), _WORD_DIMS)] += 1.0 / len(words)
    out[-_PLAIN_DIMS:] = [
        np.log1p(len(text)) / 8, np.log1p(len(words)) / 6, min(1.0, linked / max(len(text), 1)), text.count(".") / max(len(words), 1),
        text[-1] in ".!?", 0, 0, any(c.isdigit() for c in text),
    ]
    return out


def block_features(blocks: list[tuple], first: int = 0, total: int | None = None) -> np.ndarray:
    """A vector for each block: hashed words of the whole path (deeper ones count more), names of large parts of the page
    (deeper ones among them count more), hashed words, plain numbers.

    A block is what page_blocks gives, or what `taught` gives: with the length and features of its whole text.
    `blocks` may be a window of a page of `total` blocks that starts at the one numbered `first`.
    """
    total = len(blocks) if total is None else total
    out = np.zeros((len(blocks), _INPUTS))
    of_path: dict[tuple[str, ...] | Path, np.ndarray] = {}
    for i, (text, path, linked, *known) in enumerate(blocks):
        if path not in of_path:
            of_path[path] = path.features() if isinstance(path, Path) else path_features(path)
        out[i, : _PATH_DIMS + _MARK_DIMS] = of_path[path]
        out[i, _PATH_DIMS + _MARK_DIMS :] = known[1] if known else text_features(text, linked)
        out[i, -3:-1] = (first + i) / total, (total - 1 - first - i) / total
    return out


def silver_labels(blocks: list[tuple]) -> np.ndarray:
    """1 for a block of the article by the names of its elements: the innermost name that says something decides."""
    out = np.zeros(len(blocks))
    for i, (text, path, linked, *known) in enumerate(blocks):
        length = known[0] if known else len(text)
        if isinstance(path, Path):
            _, _, inside, outside = path.seen()
        else:
            named = [w for w in path if w in _OUTSIDE or w in _INSIDE and w != "body"]
            inside = named[-1] in _INSIDE if named else None
            outside = any(w in _SURROUNDINGS for w in path)
        out[i] = float(length > 80 and linked < length / 3) if inside is None else inside
        # an article inside a comment list is a comment
        if outside:
            out[i] = 0
    return out


def thinned(labels: np.ndarray, most: int) -> list[int]:
    """Places of at most `most` blocks: of all, or of the ends of each run of equal labels."""
    kept = list(range(len(labels)))
    edges = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(labels)]
    run = most
    while len(kept) > most and run > 1:
        run //= 2
        kept = [i for low, high in zip(edges, edges[1:]) for i in range(low, high) if i < low + (run + 1) // 2 or i >= high - run // 2]
    if len(kept) > most:
        # many short runs: some of them at the start, in the middle and at the end
        third = -(-most // 3)
        middle = (len(kept) - third) // 2
        kept = sorted({*kept[:third], *kept[middle : middle + third], *kept[len(kept) - third :]})[:most]
    return kept


def taught(page: str | None) -> list[tuple]:
    """What a page hands to training: (start of the text, path, characters in links, length, text features) of blocks.

    A page of many or heavy blocks hands over the ends of its runs of equal labels, so that no page is
    too large to take part and menus of any length leave room for the article.
    """
    blocks = shared_blocks(page)
    labels = silver_labels(blocks)
    # variations use less than 400 characters of a text
    weights = [4 * min(len(text), 400) + path.weight + 8 * (_WORD_DIMS + _PLAIN_DIMS) for text, path, _ in blocks]
    # a block may weigh too much by its path alone
    light = [i for i, w in enumerate(weights) if w <= FIT_BYTES]
    most = FIT_BLOCKS
    kept = thinned(labels[light], most)
    while sum(weights[light[i]] for i in kept) > FIT_BYTES:
        most //= 2
        kept = thinned(labels[light], most)
    found = (blocks[light[i]] for i in kept)
    return [(text[:400], path.words(), linked, len(text), text_features(text, linked)) for text, path, linked in found]


def vary(blocks, others, rng) -> list:
    """A page in other clothes: another container for its article, further blocks that are none."""
    containers = [("article",), ("main",), ("main", "article"), ("div", "content"), ("div", "post", "content"), ("section", "story"), ("div", "entry", "text")]
    swap = containers[rng.integers(len(containers))] if rng.random() < 0.5 else None
    page = []
    for text, path, *rest in blocks:
        if swap and "article" in path:
            at = path.index("article")
            path = path[:at] + swap + path[at + 1 :]
        page.append((text, path, *rest))
    outside = sorted(_OUTSIDE)
    for _ in range(rng.integers(0, 5)):
        word = outside[rng.integers(len(outside))]
        tags = ("form", "aside", "nav", "footer", "dialog", "menu", "header")
        inner = [("p",), ("ul", "li"), ("div",), ("span",), ("h3",), ("section", "p")][rng.integers(6)]
        path = ("html", "body", *((word,) if word in tags else ("div", word)), *inner)
        if rng.random() < 0.25:
            path = ("html", "body", "article", *((word,) if word in tags else ("div", word)), *inner)
        run = [others[rng.integers(len(others))][0] for _ in range(rng.integers(1, 4))]
        at = rng.integers(len(page) + 1)
        page[at:at] = [(text[: rng.integers(20, 400)].strip() or text, path, 0) for text in run]
    return page


def unnamed(blocks: list[tuple], rng) -> list[tuple]:
    """A page without some or all of the names that tell its parts, so that texts and neighbours have to."""
    names = sorted({w for _, path, *_ in blocks for w in path if w in _OUTSIDE or w in _INSIDE and w != "body"})
    share = (0.5, 1.0)[rng.integers(2)]
    dropped = {w for w in names if rng.random() < share}
    return [(text, tuple("div" if w in dropped else w for w in path), *rest) for text, path, *rest in blocks]


class BlockLabeller:
    """A bidirectional LSTM with one output for each block."""

    def __init__(self, inputs: int, hidden: int = _HIDDEN, seed: int = 5):
        rng = np.random.RandomState(seed)
        self.hidden = hidden
        self.w = {}
        for side in "fb":
            self.w[f"x{side}"] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden))
            self.w[f"h{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.w[f"c{side}"] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)
        self.w["o"] = rng.normal(0, 0.1, (2 * hidden + inputs, 1))
        self.w["d"] = np.zeros(1)

    def _side(self, x, mask, side):
        steps, rows, _ = x.shape
        h = np.zeros((rows, self.hidden))
        c = np.zeros_like(h)
        drive = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        states, out = [], np.zeros((steps, rows, self.hidden))
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gates = drive[t] + h @ self.w[f"h{side}"]
            i, f, o = (1 / (1 + np.exp(-gates[:, k * self.hidden : (k + 1) * self.hidden])) for k in range(3))
            g = np.tanh(gates[:, 3 * self.hidden :])
            new_c = f * c + i * g
            top = np.tanh(new_c)
            new_h = o * top
            on = mask[t][:, None]
            states.append((t, h, c, i, f, o, g, top, on))
            c, h = np.where(on, new_c, c), np.where(on, new_h, h)
            out[t] = h
        return out, states

    def forward(self, x, mask):
        """x is (steps, pages, inputs); probabilities (steps, pages) and what training needs."""
        sides = [self._side(x, mask, s) for s in "fb"]
        joined = np.concatenate([sides[0][0], sides[1][0], x], axis=2)
        logit = (joined @ self.w["o"])[:, :, 0] + self.w["d"]
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60))), joined, sides

    def gradients(self, x, mask, target):
        p, joined, sides = self.forward(x, mask)
        error = (p - target) * mask / max(mask.sum(), 1)
        grad = {"o": np.einsum("tbk,tb->k", joined, error)[:, None], "d": np.array([error.sum()])}
        back = error[:, :, None] * self.w["o"][:, 0]
        n = self.hidden
        for side, (_, states), flow in (("f", sides[0], back[:, :, :n]), ("b", sides[1], back[:, :, n : 2 * n])):
            dx, dh, db = np.zeros_like(self.w[f"x{side}"]), np.zeros_like(self.w[f"h{side}"]), np.zeros(4 * n)
            carry_h, carry_c = np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n))
            for t, h, c, i, f, o, g, top, on in reversed(states):
                total = carry_h + flow[t]
                to_c = carry_c + total * o * (1 - top**2)
                gates = np.concatenate([to_c * g * i * (1 - i), to_c * c * f * (1 - f), total * top * o * (1 - o), to_c * i * (1 - g**2)], axis=1) * on
                dx += x[t].T @ gates
                dh += h.T @ gates
                db += gates.sum(axis=0)
                carry_h = np.where(on, gates @ self.w[f"h{side}"].T, total)
                carry_c = np.where(on, to_c * f, carry_c)
            grad |= {f"x{side}": dx, f"h{side}": dh, f"c{side}": db}
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 32, seed: int = 7) -> None:
        rng = np.random.RandomState(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for low in range(0, len(order), batch):
                x, mask, target = pad([pages[i] for i in order[low : low + batch]])
                step += 1
                for k, g in self.gradients(x, mask, target).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def label(self, pages: list, features=lambda page, low, high: page[low:high]) -> list[np.ndarray]:
        """Probabilities for the blocks of each page; pages of similar length go together, long ones alone.

        `features(page, low, high)` gives the vectors of some blocks; those of at most _CELLS blocks are held at a time.
        """
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: -len(pages[i]))
        while order:
            longest = len(pages[order[0]])
            if longest > _CELLS:
                out[order[0]] = self._label_long(lambda low, high, page=pages[order[0]]: features(page, low, high), longest)
                order = order[1:]
                continue
            part, order = order[: min(64, _CELLS // longest)], order[min(64, _CELLS // longest) :]
            x, mask, _ = pad([(features(pages[i], 0, len(pages[i])), np.zeros(len(pages[i]))) for i in part])
            p = self.forward(x, mask)[0]
            for column, i in enumerate(part):
                out[i] = p[: len(pages[i]), column]
        return out

    def _label_long(self, features, total: int) -> np.ndarray:
        """The same for one page, window by window: only the outputs of the windows before are kept."""
        windows = [(low, min(low + _CELLS, total)) for low in range(0, total, _CELLS)]
        n = self.hidden
        logit = np.full(total, self.w["d"][0])
        for place, side in enumerate("fb"):
            h, c = np.zeros(n), np.zeros(n)
            out = self.w["o"][place * n : (place + 1) * n, 0]
            for low, high in windows if side == "f" else reversed(windows):
                x = features(low, high)
                drive = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
                if side == "f":
                    logit[low:high] += x @ self.w["o"][2 * n :, 0]
                for t in range(high - low) if side == "f" else range(high - low - 1, -1, -1):
                    gates = drive[t] + h @ self.w[f"h{side}"]
                    i, f, o = 1 / (1 + np.exp(-gates[: 3 * n].reshape(3, n)))
                    c = f * c + i * np.tanh(gates[3 * n :])
                    h = o * np.tanh(c)
                    logit[low + t] += h @ out
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def pad(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(y) for _, y in pages)
    x = np.zeros((steps, len(pages), pages[0][0].shape[1]))
    mask, target = np.zeros((steps, len(pages)), dtype=bool), np.zeros((steps, len(pages)))
    for i, (features, labels) in enumerate(pages):
        x[: len(labels), i], mask[: len(labels), i], target[: len(labels), i] = features, True, labels
    return x, mask, target


def train_labeller(parsed: list[list[tuple]]) -> BlockLabeller:
    """Fit on the blocks of pages, as `taught` gives them, and on variations of them, with labels from the names of their elements."""
    rng = np.random.default_rng(13)
    every = [block for b in parsed for block in b]
    varied = parsed + [vary(b, every, rng) for b in parsed for _ in range(2)]
    lessons = [(block_features(b), silver_labels(b)) for b in varied]
    lessons += [(block_features(unnamed(b, rng)), silver_labels(b)) for b in parsed]
    labeller = BlockLabeller(_INPUTS)
    labeller.fit(lessons)
    return labeller


def _teach(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, pages in batches(["key", "html"], rows, 16):
        found = [(k, pickle.dumps(b)) for k, b in zip(keys, map(taught, pages)) if b]
        yield pa.record_batch({"key": pa.array([k for k, _ in found], pa.int64()), "blocks": pa.array([b for _, b in found], pa.binary())})


def training_sample(pages: DataFrame, most: int) -> list[list[tuple]]:
    """Blocks of at most `most` pages with text, drawn by a hash from pages of all sizes; empty only if no page has any.

    Pages are parsed in the tasks; the driver gets at most FIT_BYTES of each.
    """
    keyed = pages.where(F.octet_length("html") > 0).select(hash_key("page_id", "html").alias("key"), "html")

    def lowest(given: DataFrame) -> list[list[tuple]]:
        rows = given.mapInArrow(_teach, "key long, blocks binary").orderBy("key").limit(most)
        return [pickle.loads(r.blocks) for r in rows.select("blocks").collect()]

    # only keys are ordered, whatever the pages weigh; about four times as many as are wanted pass the bound
    keys = keyed.select("key")
    bound = int(min(1.0, 4 * (most + 50) / max(keys.count(), 1)) * HASH_KEYS)
    last = keys.where(F.col("key") <= bound).orderBy("key").limit(most).agg(F.max("key")).first()[0]
    if last is None:
        return []
    # pages without text may be all that was drawn: then every page is looked at
    return lowest(keyed.where(F.col("key") <= last)) or lowest(keyed)


def _extract(labeller: BlockLabeller | None):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, pages in batches(["page_id", "url", "html"], rows, 128):
            parsed = [shared_blocks(p) for p in pages]
            if labeller is None:
                if any(parsed):
                    raise ValueError("pages have text, but none of them could train the labeller")
                yield _texts(ids, urls, [""] * len(ids))
                continue
            labels = labeller.label(parsed, lambda b, low, high: block_features(b[low:high], low, len(b)))
            texts = ["\n".join(text for (text, _, _), p in zip(b, y) if p >= 0.5) for b, y in zip(parsed, labels)]
            yield _texts(ids, urls, texts)

    return run


def _texts(ids: list, urls: list, texts: list[str]) -> pa.RecordBatch:
    return pa.record_batch(
        {"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()), "text": pa.array(texts, pa.string()),
         "n_chars": pa.array([len(t) for t in texts], pa.int64())}
    )


def extract_text(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages(page_id, url, html)`.

    At most `fit_pages` pages of any size, drawn by a hash, train the labeller, each by at most FIT_BLOCKS
    blocks and FIT_BYTES bytes of them; its labels for training come
    from element names and their class and id words (words of states such as `has-sidebar`, and of the page as a whole, do not
    count), and variations of the pages show it containers and surroundings that the given pages lack, and parts without names. It then reads every whole page as a
    sequence of blocks and decides each one with the document on both sides of it. Blocks that
    are kept are joined by line breaks.

    A null html counts as empty; a page without kept blocks has the empty text. Null ids and urls
    are passed on, repeated rows get equal results. An empty table gives no row.
    """
    rows = pages.select("page_id", "url", "html")
    sample = training_sample(rows, fit_pages)
    labeller = train_labeller(sample) if sample else None
    return rows.mapInArrow(_extract(labeller), "page_id long, url string, text string, n_chars long")

"""Pages without their furniture: which blocks of a page, or lines of a text, belong to the main body."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Headings of end matter; a section under one is dropped (fixed values).
END_MATTER = {"references", "notes", "citations", "bibliography", "external links", "further reading", "see also"}
#: Words in a class or id, and tags, that tell a container's role.
ROLES = re.compile(
    r"(?:^|[-_ ])(?:nav|navbar|navigation|menu|topnav|breadcrumbs?|pager|pagination|footer|colophon|legal|imprint|site-info|site-header|masthead|mw-head|mw-panel|head|panel|sidebar|rail|"
    r"related|recommended|teasers?|promo|ads?|advert|inline-ad|sponsor|banner|cookies?|cookie-banner|consent|gdpr|notice|privacy|share|sharing|social|newsletter|subscribe|comments?|"
    r"discussion|replies|reply|disqus|tags|catlinks)(?:$|[-_ ])", re.I,
)
ROLE_TAGS = {"nav", "aside", "footer", "header", "form"}
BLOCKS = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"body", "div", "section", "article", "main", "nav", "aside", "footer", "header", "form", "ul", "ol", "table", "figure", "blockquote"}
SILENT = {"script", "style"}
#: Blocks around a line that smooth its text-to-tag ratio (one standard deviation); evidence a block needs; most that one feature gives.
SIGMA, EVIDENCE, CLIP = 1.0, 2.5, 2.5
#: Pages on which the model of furniture's words is fitted at most; the choice is by hash of the page's id.
FIT_PAGES = 2_000
#: Characters of a block up to which furniture's wording decides alone.
LONGEST = 220
_MENU = re.compile(r"\s*[|/·•»>]\s*|\s{2,}|^\s+|\s+$")

#: Wording of page furniture, by which the model of words starts; what it says of a block stands.
WORDING = re.compile(
    r"""(?:©|\(c\)\s*\d{4}|copyright)|all\ rights\ reserved|terms\ of\ use|imprint|(?:open|free)\ (?:terms|licen[cs]e)\ of|is\ a\ trading\ name|registered\ under\ no|non-profit\ body
    |\b(?:we|you|your|this\ site|our|vendors)\b[^.!?]*\bcookies?\b|\bcookies?\b[^.!?]*(?:\b(?:we|you|your|this\ site|vendors|statement|policy|rules)\b|\[(?:allow|accept|deny|reject|ok|settings))|fine\ by\ me|^your\ (?:privacy|choices)\b|allow\ statistics
    |^\W*(?:ad|advert|advertisement|sponsored|promoted)\b(?:\W*$|\ by\b|\W*(?:·|—|-|scroll|story))|\bsubscribe\ to\b|\bnewsletter\b.*\be-?mail\b|\bsign\ up\b|free\ articles?\ left|become\ a\ (?:member|subscriber)
    |^get\ the\ .*\bapp\b|turn\ on\ notifications|^follow\ (?:us\b|.*\bon\ \w+)|^(?:share|tell\ others|send\ (?:this\ |it\ )?to\ a\ friend|share\ this)\b\W|^(?:recommend|forward)\ this\b
    |leave\ a\ reply|required\ fields|log\ in\ to\ (?:post|reply|comment)|report\ this\ comment|^load\ \d*\ ?more|^\d[\d,]*\ (?:comments?|replies|shares|views|likes)\W*$|\b\d+\ min(?:utes?)?\ read\b
    |^(?:skip|jump)\ to\b|^toggle\ menu|☰|^back\ to\ top|^(?:home|main\ page|start\ page)\ (?:>|»|/|›)\ |^(?:page\ \d+\ of\ \d+|showing\ \d+)|^(?:\d+\ ){2,}\d+\W*(?:next)?\W*$(?<=[^\d])|^views?:\ *\d|last\ (?:edited|updated|modified|changed)\b.*\d
    |^(?:related|see\ next|read\ (?:next|also|more)|more\ like\ this|you\ may\ also\ like|trending(?:\ now)?|popular(?:\ (?:now|this\ week))?|most\ read|top\ stories|recommended|more\ from\b.*?)\W*[:»]
    |^(?:tags|topics|labels|filed\ under|keywords|categories|posted\ in|tagged)\ ?[:—–]|^\W*(?:previous|next|older|newer)\b\W*[:→].*|^[«←].*\bnext\b|redirected\ from|not\ to\ be\ (?:mixed\ up|confused)\ with|\bsimilar\ titles\b
    |^from\ .{1,60},\ the\ (?:open|free)\ \w+$|listen\ to\ this|was\ this\ (?:page|article)\ helpful|^enjoying\ .*\?|^run\ by\b""", re.I | re.X,
)

_NUMBER = re.compile(r"\d[\d.,:/]*")
_NAME = re.compile(r"(?<=[^.?!:/|·•»>←→—\s-]) [A-Z][^\W\d_]*[a-z][^\W\d_]*")
_TERM = re.compile(r"[^\W_]+|[^\w\s,.;\"'()]")
_SEPARATORS = {"|": "sep|", "/": "sep/", "·": "sep·", "•": "sep·", "»": "sep»", ">": "sep>"}


class Page(HTMLParser):
    """A page as its blocks: opening tags p, li and h1 to h6, numbered from 0 outside comments, scripts and styles.

    Each block has the text up to the next block, the characters of links in it, the tags among it, and its chain of open
    containers. A closing tag closes the innermost open element of its name, and those within; without one it is ignored.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.parents: dict[int, int] = {}
        self.roles: dict[int, bool] = {}
        self.names: dict[int, str] = {}
        self.blocks: list[dict] = []
        self.count, self.link, self.silent, self.current = 0, 0, 0, None
        self.feed(html)
        self.close()
        if self.rawdata:  # an unfinished tag at the end of a page that breaks off
            self.rawdata = ""

    def chain(self) -> tuple[int, ...]:
        return tuple(i for t, i in self.stack if t in CONTAINERS)

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
            return
        if self.current is not None:
            self.current["tags"] += 1
        if tag == "a":
            self.link += 1
        elif tag in BLOCKS:
            self.current = {"tag": tag, "text": [], "link": 0, "tags": 1, "chain": self.chain()}
            self.blocks.append(self.current)
        if tag in CONTAINERS:
            self.count += 1
            named = " ".join(v or "" for k, v in attrs if k in {"class", "id", "role"})
            self.roles[self.count] = tag in ROLE_TAGS or bool(named and ROLES.search(named)) and tag not in {"ul", "ol", "body", "main", "article"}
            self.names[self.count] = tag
            self.parents[self.count] = next((i for t, i in reversed(self.stack) if t in CONTAINERS), 0)
            self.stack.append((tag, self.count))
            if tag not in {"ul", "ol", "table", "figure"}:
                self.current = None

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "a":
            self.link = max(0, self.link - 1)
        elif tag in BLOCKS:
            if self.current is not None and self.current["tag"] == tag:
                self.current = None
        elif tag in CONTAINERS:
            at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag), None)
            if at is not None:
                del self.stack[at:]
                self.current = None

    def handle_data(self, data):
        if self.silent or self.current is None:
            return
        self.current["text"].append(data)
        if self.link:
            self.current["link"] += len("".join(data.split()))


def parsed(html: str | None) -> Page:
    page = Page(html or "")
    for b in page.blocks:
        b["text"] = " ".join("".join(b["text"]).split())
        b["size"] = len(b["text"].replace(" ", ""))
    return page


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Values under a Gaussian kernel of radius three deviations, normalised at both ends."""
    if not len(values):
        return values
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel, "full")[reach:-reach] / np.convolve(np.ones(len(values)), kernel, "full")[reach:-reach]


def two_clusters(values: np.ndarray) -> float:
    """The threshold between the two clusters of the values (means of two, from the extremes)."""
    ordered = np.sort(values)
    sums = np.cumsum(ordered)
    n, cut = len(ordered), (ordered[0] + ordered[-1]) / 2
    for _ in range(30):
        k = int(np.searchsorted(ordered, cut, "right"))
        if k in (0, n):
            break
        new = (sums[k - 1] / k + (sums[-1] - sums[k - 1]) / (n - k)) / 2
        if new == cut:
            break
        cut = new
    return float(cut)


def content_container(page: Page) -> int:
    """The container of the main body: 0 if it is the whole page.

    Lines (blocks) get the ratio of text outside links to tags, smoothed over their neighbours; the upper cluster of the
    ratios is content. The deepest container that holds most of the content's text is taken, then widened to the one
    that also holds the first h1, where there is one below the body.
    """
    texts = [b for b in page.blocks if b["size"]]
    if not texts:
        return 0
    ratio = smoothed(np.array([np.log1p(max(0, b["size"] - b["link"]) / b["tags"]) for b in texts]))
    cut = two_clusters(ratio)
    held: dict[int, float] = {}
    total = 0
    for b, r in zip(texts, ratio, strict=True):
        if r > cut and not any(page.roles[i] for i in b["chain"]):
            total += b["size"]
            for i in set(b["chain"]):
                held[i] = held.get(i, 0) + b["size"]
    fit = [i for i, n in held.items() if n >= 0.7 * total and page.names[i] in {"div", "section", "article", "main"}]
    top = next((b for b in page.blocks if b["tag"] == "h1" and b["size"] and not any(page.roles[i] for i in b["chain"])), None)
    if top is not None:
        own = [i for i in top["chain"] if page.names[i] in {"div", "section", "article", "main"}]
        if own and held.get(own[-1], 0) >= 0.2 * total:
            return own[-1]
        for i in reversed(own):
            if held.get(i, 0) >= 0.5 * total:
                return i
        if not own:
            after = [i for i in fit if i > 0]
            inner = max(after, default=0)
            return inner if inner and page.names[inner] in {"article", "main"} else 0
    return max(fit, default=0)


def page_labels(page: Page) -> tuple[list[str], int]:
    """What the structure says of each block: out (outside the main body), end (end matter), in, or empty; and the container of the main body."""
    inside = content_container(page)
    labels, end_level, end_chain = [], 0, ()
    started = not any(b["tag"] == "h1" and b["size"] for b in page.blocks)
    for b in page.blocks:
        chain = b["chain"]
        started = started or b["tag"] == "h1"
        if b["tag"][0] == "h":
            level = int(b["tag"][1])
            title = re.sub(r"\s*(?:\[\w+\]\s*)+$", "", b["text"]).strip(" :.").casefold()
            if title in END_MATTER:
                end_level, end_chain = level, chain
            elif end_level and level <= end_level and b["size"]:
                end_level = 0
        if end_level and chain[: len(end_chain)] != end_chain:
            end_level = 0
        if not b["size"]:
            labels.append("empty")
            continue
        below = chain[chain.index(inside) + 1 :] if inside in chain else chain if not inside else None
        if below is None or any(page.roles[i] for i in chain) or not inside and not started:
            labels.append("out")
        elif end_level:
            labels.append("end")
        else:
            labels.append("in")
    # boxes of links inside the main body
    boxes: dict[int, list[int]] = {}
    for k, b in enumerate(page.blocks):
        for i in b["chain"]:
            if page.names[i] == "div" and i != inside and labels[k] == "in" and (not inside or inside in b["chain"] and b["chain"].index(i) > b["chain"].index(inside)):
                boxes.setdefault(i, []).append(k)
    for ks in boxes.values():
        size = sum(page.blocks[k]["size"] for k in ks)
        if sum(page.blocks[k]["link"] for k in ks) > 0.75 * size:
            for k in ks:
                labels[k] = "out"
    return labels, inside


def words_of(text: str) -> list[str]:
    """The words and marks of a text in lower case; numbers are 0, capitalised words inside a sentence xx."""
    return _TERM.findall(_NAME.sub(" Xx", _NUMBER.sub("0", text)).lower())


def cues(text: str) -> list:
    """The features of a text in the model: words, pairs of words, its opening, its whole if short, and its separators."""
    words = words_of(text)
    if not words:
        return []
    out = [*words, *zip(words, words[1:], strict=False), ("^", *words[:2]), (words[-1], "$")]
    if len(words) <= 5:
        out.append("=" + text.strip().lower())
    if len(text) <= LONGEST:
        for mark, name in _SEPARATORS.items():
            c = words.count(mark)
            if c >= 2 and len(words) <= 6 * (c + 1):
                out.append(name)
    return out


def fit_cues(pages: DataFrame) -> dict:
    """Log odds of furniture for each feature, from pages (id, html): blocks that the structure puts outside the main body against
    those inside. Titles that link to other pages say nothing of furniture's wording and aren't counted.

    At most about FIT_PAGES pages are used, the same share of any id; the features seen three times or more in them are
    what the driver gets, so the model's size is bounded.
    """
    pages = pages.where("id is not null and html is not null")
    share = min(1.0, FIT_PAGES / max(1, pages.count()))
    sample = pages.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("html")

    def run(batches):
        import json
        from collections import Counter

        import pyarrow as pa

        counts: Counter = Counter()
        for batch in batches:
            for html in batch.column(0).to_pylist():
                page = parsed(html)
                for b, label in zip(page.blocks, page_labels(page)[0], strict=True):
                    if label in {"in", "out"} and len(b["text"]) <= LONGEST and WORDING.search(b["text"]):
                        side = 1
                    elif label == "in":
                        side = 0
                    elif label == "out" and (b["link"] < 0.5 * b["size"] or b["text"].count(" ") <= 1):
                        side = 1
                    else:
                        continue
                    counts[side, None] += 1
                    counts.update((side, f) for f in set(cues(b["text"])))
        keys = [k for k in counts]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([json.dumps(k[1]) for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["side", "feature", "n"])

    import json

    rows = sample.mapInArrow(run, "side long, feature string, n long").groupBy("feature").agg(F.sum(F.expr("if(side = 0, n, 0)")).alias("inside"), F.sum(F.expr("if(side = 1, n, 0)")).alias("outside"))
    found = rows.where(F.col("inside") + F.col("outside") >= 3).collect()
    total = next(((r[1], r[2]) for r in found if r[0] == "null"), (0, 0))
    odds = {}
    for feature, n_in, n_out in found:
        value = np.log((n_out + 0.3) / (total[1] + 1.0)) - np.log((n_in + 0.3) / (total[0] + 1.0))
        if feature != "null" and abs(value) > 0.2:
            key = json.loads(feature)
            odds[tuple(key) if isinstance(key, list) else key] = float(max(-CLIP, min(CLIP, value)))
    return odds


def evidence(text: str, odds: dict) -> float:
    """Furniture's log odds of a text: of its five strongest features each way, so that length alone decides nothing; unless they
    speak clearly against it, known wording or a row of known menu entries is enough."""
    if not text:
        return 0.0
    found = dict.fromkeys(cues(text))
    x = sorted(filter(None, map(odds.get, found)))
    total = sum(v for v in x[-5:] if v > 0) + sum(v for v in x[:5] if v < 0)
    if total <= -3 * EVIDENCE and x[-1] < 1.0:
        return total
    if len(text) <= LONGEST:
        if WORDING.search(text):
            return 4 * CLIP
        items = [x for x in _MENU.split(text) if x]
        if len(items) >= 3 and sum(odds.get("=" + x.lower(), 0) > 1.5 for x in items) >= 0.6 * len(items):
            return 4 * CLIP
    if total > EVIDENCE:
        words = [w for w in found if isinstance(w, str) and w.isalpha()]
        if 3 * sum(odds.get(w, 0) > 0.5 for w in words) < max(1, len(words)):
            return EVIDENCE  # chance hits among words the model doesn't know
    return total


def page_main(page: Page, odds: dict) -> list[bool]:
    """Whether each block of a page is of its main body: inside by structure, without furniture's wording, and in no box of furniture.

    A box (div, section) inside the main body is furniture if its heading is; if a good third of its blocks are, all but its paragraphs
    of prose are. So boxes go that run on inside because their page doesn't close its article.
    """
    labels, inside = page_labels(page)
    flagged = [label == "in" and evidence(b["text"], odds) > EVIDENCE for b, label in zip(page.blocks, labels, strict=True)]
    main = [label == "in" and not bad for label, bad in zip(labels, flagged, strict=True)]
    boxes: dict[int, list[int]] = {}
    for k, b in enumerate(page.blocks):
        if labels[k] == "in":
            below = b["chain"][b["chain"].index(inside) + 1 :] if inside in b["chain"] else b["chain"][1:]
            for i in below:
                if page.names[i] in {"div", "section"}:
                    boxes.setdefault(i, []).append(k)
    for ks in boxes.values():
        top = page.blocks[ks[0]]
        headed = flagged[ks[0]] and len(top["text"]) <= 40 and (top["tag"][0] == "h" or not WORDING.search(top["text"]) or top["text"][0].isdigit())
        if headed or sum(flagged[k] for k in ks) > 0.35 * len(ks):
            for k in ks:
                b = page.blocks[k]
                prose = b["tag"] == "p" and b["size"] > 60 and evidence(b["text"], odds) < -2 * EVIDENCE
                main[k] = main[k] and prose and not headed
    return main


_WORDS, _DIGITS, _CELLS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"\s*[|\t;]\s*")
_ROW = re.compile(r"^\s*(?:[-*+•]\s|\d{1,4}[.)]\s)|\t|[{}=;]|^\s*\||\|\s*-{3}|^\s*[\"\[]|^[0-9a-f]{8}\s|^\d{4}-\d\d-\d\d\s|^\s*[-\d.,\s]+$|[,;][^\s,;]+[,;]")


def line_labels(text: str, odds: dict) -> list[bool]:
    """Whether each line of a text is furniture. Rows of lists, tables, code and data next to like rows are main body; in the
    second half of a text, a line that is a title of end matter and all behind it are not."""
    lines = text.split("\n")
    shape = [_WORDS.sub("a", _DIGITS.sub("0", x.lstrip()[:40]))[:1] if _ROW.search(x) else "" for x in lines]
    out: list[bool] = []
    ended = False
    for k, line in enumerate(lines):
        stripped = line.strip()
        ended = ended or 2 * k >= len(lines) and stripped.strip(" #:=*").casefold() in END_MATTER
        if not stripped or ended:
            out.append(bool(stripped))
            continue
        cells = _CELLS.split(stripped.strip("|")) if len(stripped) <= LONGEST else ()
        if len(cells) >= 2 and 2 * sum(c[:1].isdigit() for c in cells) >= len(cells):
            out.append(False)  # a row of figures
            continue
        if len(stripped) > 40 and " " not in stripped:
            out.append(False)  # one long word isn't wording
            continue
        near = [shape[j] for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < len(lines)]
        row = bool(shape[k]) and shape[k] in near
        out.append(not row and evidence(stripped, odds) > EVIDENCE)
    return out


def block_table(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """(origin, record_id, block_no, main, block): each block with visible text of pages (id, html) and each line with text of texts (id, text).

    main: whether it is of the main body. Repeated rows count once; null, empty and blockless pages and texts have no rows.
    Numbers count empty blocks and lines too.
    """
    sc = pages.sparkSession.sparkContext
    shared = sc.broadcast(fit_cues(pages))
    schema = "record_id long, block_no long, main boolean, block string"

    def build(rows, pa):
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["record_id", "block_no", "main", "block"])

    def of_pages(batches):
        import pyarrow as pa

        odds = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                rows = []
                for key, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    page = parsed(html)
                    rows += [(key, k, main, b["text"]) for k, (b, main) in enumerate(zip(page.blocks, page_main(page, odds), strict=True)) if b["size"]]
                yield build(rows, pa)

    def of_texts(batches):
        import pyarrow as pa

        odds = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                rows = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text:
                        rows += [(key, k, not bad, line) for k, (line, bad) in enumerate(zip(text.split("\n"), line_labels(text, odds), strict=True)) if line.strip()]
                yield build(rows, pa)

    html = pages.select("id", "html").where("id is not null and html is not null").mapInArrow(of_pages, schema).select(F.lit("html").alias("origin"), "*")
    lines = texts.select("id", "text").where("id is not null and text is not null").mapInArrow(of_texts, schema).select(F.lit("content").alias("origin"), "*")
    return html.union(lines)


def furniture(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """(origin, record_id, block_no) of the blocks and lines that aren't of the main body, once."""
    return block_table(pages, texts).where("not main").select("origin", "record_id", "block_no").distinct()


def main_bodies(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """(origin, record_id, body): the blocks or lines of the main body, joined by line breaks; a row for each record that has any."""
    rows = block_table(pages, texts).where("main").dropDuplicates(["origin", "record_id", "block_no"])
    parts = rows.groupBy("origin", "record_id").agg(F.sort_array(F.collect_list(F.struct("block_no", "block"))).alias("x"))
    return parts.select("origin", "record_id", F.array_join("x.block", "\n").alias("body"))

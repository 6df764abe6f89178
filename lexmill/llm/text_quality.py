"""Text statistics of documents, and whether a document is running prose, by a Gaussian mixture over text blocks."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, word_list, written

#: Inspected examples, invented: the kind of each component of the mixture, its name, and blocks that belong to it.
EXAMPLES: list[tuple[str, str, list[str]]] = [
    ("prose", "sentences", [
        "The harbour was quiet when the ferry came in, and nobody had thought to light the lamps along the pier.",
        "It took nine days to repair the old mill. The owner paid for the timber, but the village gave the work for nothing.",
        "WE COULD NOT REACH THE STATION BEFORE DARK, SO WE SLEPT IN THE BARN AND WALKED ON IN THE MORNING.",
        "there are 48 ways to read this letter; most of them are wrong, and one is dull",
        "Der Bericht nennt 317 Fälle, aber niemand weiß, wer sie gezählt hat und wann das geschah.",
        "Le directeur ne voulait pas que la lettre parte avant midi, car il attendait encore une réponse.",
        "Cada semana los vecinos cuentan las barcas que faltan, pero nadie escribe los nombres en el libro.",
        "What the archive keeps is a record of 1,204 small repairs, not the plans of the house.",
    ]),
    ("prose", "short sentences", [
        "He left at noon.", "The gate was open, and one lamp still burned.", "Most of it was lost.", "Nobody answered the letter.",
        "And the rest followed quietly.", "Sin la llave no se abre.", "Ohne den Plan geht es nicht.", "Il reste trois pages.",
    ]),
    ("prose", "other scripts", [
        "Старый мост закрыли вчера. Рабочие ждут новых досок, а лодки стоят у берега.", "Учитель пишет письмо утром.",
        "Читатель находит в архиве старую карту и убирает её обратно.", "Смотритель ждёт парома ночью, потому что буря прошла.",
        "古い橋は昨日閉じられた。職人は新しい板を待っている。", "灯台の番人は夜に手紙を書く。船はまだ来ない。", "図書館は古い地図を保存した。", "朝の市場は静かである。人々は魚を待つ。",
    ]),
    ("other", "headings", [
        "Notes on the harbour", "Old mills and bridges", "Lamps by Corwen", "Ferry timetable, 12", "A short history", "The lighthouse keeper", "Why rivers rise", "Quiet villages",
    ]),
    ("other", "page furniture", [
        "Home > Rivers > Bridges > Old", "Share: Mail | Print | Link", "Tags: rivers, mills, bridges, boats", "© 2019 The River Post. All rights reserved.",
        "Related: How bridges age", "Help / About / Contact / Log in / Search", "12 comments", "« Previous: The mill | Next: The ferry »",
    ]),
    ("list", "list entries", [
        "- oak plank", "• copper nails", "3. tar and rope", "12) lamp oil, two", "* anchors by Weller", "+ small lantern", "7. spare oar", "- brass bell",
    ]),
    ("list", "runs of entries", [
        "- oak plank\n- pine plank\n- copper nails\n- tar\n- rope\n- lamp oil", "1. first mate\n2. second mate\n3. cook\n4. carpenter\n5. boy", "• bread\n• salt pork\n• beer\n• dried peas\n• cheese",
        "+ blue flag\n+ red flag\n+ green lamp\n+ fog horn", "1) mill\n2) barn\n3) forge\n4) chapel\n5) school", "* spring tide\n* neap tide\n* ebb\n* slack water",
    ]),
    ("table", "bar tables", [
        "| mill | river | 1843 | 12 |", "|---|---|---|---|", "| Weller | copper | 2204 | 87.5 |", "oak | 12 | 40", "| port | depth | ships | toll |\n|---|---|---|---|\n| Arden | 12 | 340 | 2 |", "| a | b |\n|---|---|\n| 7 | 9 |",
    ]),
    ("table", "separated values", [
        "Weller\tcopper\t18203\t44.20\tok", "Arden,ferry,9921,31.07,n/a", "Corwen;bridge;40022;8.51;-", "name,kind,number,share\nArden,ferry,9921,31.07", "Holt\tlamp\t771\t90.15\t\nDene\toar\t1204\t3.44\tok", "Marsh;rope;5512;60.02;ok\nFenn;tar;88;2.00;",
    ]),
    ("table", "figures", [
        "   120.5      33.1     -87.0     904.4", "31.2 44.9 80.1 3.7 95.0", "812.0\t-4.5\t77.3\t190.8", "  44.1  90.2\n 310.7 -55.3  81.0\n  12.9", "1843 2204 1951 1777 1602", "0.12 0.55 0.93",
    ]),
    ("log", "logs", [
        "2023-04-11 09:15:02 INFO [pump-3] Weller.start rc=0 t=120ms", "2023-04-11 09:15:09 ERROR [gate-12] Arden.close rc=17 t=2204ms", "[11/Apr/2023:09:15:02] GET /mill/7 200 5120", "09:15:02 worker-4 WARN queue=88 lag=1204ms",
        "2023-04-11 09:15:02 INFO [pump-3] Weller.start rc=0 t=120ms\n2023-04-11 09:16:40 DEBUG [lamp-9] Holt.dim rc=2 t=31ms", "Apr 11 09:15:02 host7 sshd[2204]: session opened uid=1001",
    ]),
    ("data", "settings and code", [
        'mill.depth = 12\nmill.owner=Weller\nferry.toll: null', "lamp.bright=true", '"river_12": 204,', '{\n  "mill_3": false,\n  "ferry_8": [4, 7],\n  "toll_12": "Arden",\n  "depth": 33\n}', "def toll(x):\n    return x * 2 + base[i]", "for (int i = 0; i < n; i++) { sum += a[i]; }",
        "SELECT mill, sum(toll) FROM ferry GROUP BY mill;", "if depth > 12:\n    gate.close(lamp=True)\n    return None", "[river]\ndepth = 12\nwidth=40", "const gate = open(12); // toll",
    ]),
    ("data", "dumps", [
        "00001f20  4a 91 c3 00 7e b2 55 18 9d e0 3f 6b aa 12 c8 04", "0000a3b0  ff 02 9c 41 d7 68 30 ee", "0001b7c0  11 d2 7a 9e 40 c5 b8 66 03 f1 2d 84 5b e9 a0 37\n0001b7d0  8c 2e 91 f4 6a 0b d3 57 c9 18 e2 75 3f a6 4d 90", "3f 9a 00 c4 71 e8 b5 2d",
    ]),
    ("junk", "encoded bytes", [
        "Qm9hdHMgYXJl0IG9sZC4gVGhl9IG1pbGw7zIHR1cm5z+kFuZCB0aGUgZmVycnk/wYWl0cyBmb3Ig", "x9Kd02LmQpZ7aVnT4yRw/8eHbUj3cGfXs1NoI6vMkPzW+qYtEr5BhAlDuCiSgOxJ", "U2FmZSBoYXJib3VycyBrZWVwIHRoZWlyIGxhbXBzIGxpdAo9Zk3Xw7Lq\nt8Vb2NcY6RmKs0PdHfJ4gQ9uE1iZaTxWoLyMnB5vCkGjUrSe7DhXpFqAz3wI", "kY3vTz8RbQ1mXo6LwN0cJf5HdSgP2aUeI7rKxM9iWyVhBnZuEtOqDjCsGlAp4F+/",
    ]),
    ("junk", "symbol noise", [
        "~8§¤+™¢œ°¦7/¢\\/@€â[157¬¤~¬0<Ã\\¤]0±", "#86#06|[°%±¤#5|¤[8*2±86¬%*§^Â¬", "{}<>@@ ~~ ^^ %% && ## || \\\\ ±± §§", "`)n`>v*Lv `RS#0`>G¤#)n 8ZZ%nS¤ n¤vZG J0#¤!", "�?�? w����? r����? p��?�", "Ã¤¶ÃŸâ€¢Ã©â€œÂ°Ã¼â€™Â»",
    ]),
    ("junk", "letter noise", [
        "vxq mzskf jtrmyg cmkftfq zvg wqfnt tmpbcyn jfsqlxk ppsjdj gw wvwbnzk", "hxznwqj wfpspmd qsqs qyqvlmv qspmdsn qhmctg yjjhcf nv rxftgqz jzrhnd", "bcdfg hjklm npqrs tvwxz bcdkl mnprt", "ncs wfkqv qnwdrqg pqhswflx lfjz qzsnklcxh fc lctpl tmkxjtnz pk nsfcz", "xk qwr tzpl mvb ndgh skj qpfw zrtx lkmn", "zqx jvkw pltr mnbc xdfg hjkq wrtz",
    ]),
    ("junk", "spaced letters", [
        "T h e h a r b o u r w a s q u i e t", "Wh a t th e k e e p er s a w i s a l a mp , n o t t h e sh i p", "a n d n o b o dy h ad th ou g h t t o l ig h t t h e m", "F ro m t he mi l l to th e b r i dg e i t is n i n e m il e s", "o l d r o a d s", "s h i p s w a i t",
    ]),
]
KINDS = [k for k, _, _ in EXAMPLES]
N_FEATURES = 14
#: Rounds at most, and nats a block that a round must gain for another to follow; weight of the examples; least variance.
ROUNDS, LEAST_GAIN, PRIOR_SHARE, FLOOR = 12, 0.02, 0.004, 0.08
#: Common words that are used at most.
MOST_WORDS = 100_000

_WORDS = re.compile(r"[^\W\d_]+")
_TOKENS = re.compile(r"\S+")
_END = re.compile(r"[.!?…。;:][\"'”’»)\]]*$")
_MARK = re.compile(r"^\s*(?:[-*•◦‣▪●○+·–]|\d{1,4}[.)])\s+")
_PLAIN = dict.fromkeys(map(ord, ".,;:!?'\"()-…—–。、«»“”‘’¿¡"))
_DIGITS, _NOT_LATIN = re.compile(r"\d+"), re.compile(r"[^\x00-\u024f]+")
_ENDS = re.compile(r"[.!?…。][\"'”’»)\]]*$")
_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = np.arange(1, 27)
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_DELIM = re.compile(r"[\t|=<>{}\[\]\\/+#@~^*_]|[,;](?=\S)|;$")
_NUMERIC = re.compile(r"^[-+]?[\d.,:%/]*\d[\d.,:%/]*$")
_MIXED = re.compile(r"[a-zà-ÿ][A-Z]|[A-Za-z]\d|\d[A-Za-z]")


def blocks(text: str) -> list[str]:
    """Lines of a text, those joined again that one sentence runs over, and runs of short marked or alike lines kept together."""
    out: list[str] = []
    open_, blank = False, False
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            blank = True
            continue
        words = len(_WORDS.findall(s))
        goes_on = open_ and not _MARK.match(line) and (s[0].islower() or not blank and words >= 3)
        if goes_on:
            out[-1] += "\n" + line
        else:
            out.append(line)
        open_ = (words >= 4 or goes_on and words >= 1) and not _END.search(s)
        blank = False
    return out


def _pairs(text: str) -> np.ndarray:
    """Pairs of successive letters a to z of a text, with 0 for anything else, where at least one is a letter."""
    codes = _LETTER[np.frombuffer(text.lower().encode("ascii", "replace"), np.uint8)]
    pairs = codes[:-1] * 27 + codes[1:]
    return pairs[pairs > 0]


def letter_model(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """(bits of each pair of letters, their mean) from counts of pairs, to which the prose among the examples is added."""
    base = sum(np.bincount(_pairs(t), minlength=729) for kind, name, texts in EXAMPLES for t in texts if kind == "prose")
    share = (counts + 10.0 * base + 0.5).reshape(27, 27)
    bits = -np.log2(share / share.sum(1, keepdims=True)).ravel()
    weight = share.ravel() / share.sum()
    return bits, float((weight * bits).sum())


def fit_letters(docs: DataFrame) -> tuple[np.ndarray, float]:
    """The letter model of all texts of (text); 729 sums reach the driver."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(729, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and len(text) > 1:
                    counts += np.bincount(_pairs(text), minlength=729)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(729)), pa.array(counts)], ["i", "n"])

    counts = np.zeros(729)
    for i, n in docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n")).collect():
        counts[i] = n
    return letter_model(counts)


def block_features(part: list[str], common: set[str], letters_: tuple[np.ndarray, float]) -> np.ndarray:
    """A row of statistics for each block of one document; see the names beside the values."""
    bits, usual = letters_
    rows = np.zeros((len(part), N_FEATURES), np.float32)
    short = []
    for i, b in enumerate(part):
        solid = "".join(b.split())
        n = len(solid) or 1
        cjk = len(_CJK.findall(solid))
        words = _WORDS.findall(b.lower())
        tokens = _TOKENS.findall(b)
        letters = sum(map(len, words))
        digits = n - len(_DIGITS.sub("", solid)) if solid else 0
        plain = n - len(solid.translate(_PLAIN)) if solid else 0
        latin = letters - sum(map(len, _NOT_LATIN.findall("".join(words))))
        foreign = letters > 2 * latin
        count = max(1, len(words) - (1 if cjk else 0) + cjk // 2) if cjk else max(1, len(words))
        rows[i, 0] = letters / n  # letter share
        rows[i, 1] = digits / n  # digit share
        rows[i, 2] = min(1.0, 3 * max(0, n - letters - digits - plain) / n)  # symbol share
        rows[i, 3] = np.log1p(count)  # words
        rows[i, 4] = 5.0 if cjk else min(16.0, letters / count)  # mean word length
        rows[i, 5] = 0.3 if foreign else sum(w in common for w in words) / count  # share of common words
        rows[i, 6] = bool(_ENDS.search(b.rstrip()))  # ends as a sentence
        rows[i, 7] = min(1.5, len(_DELIM.findall(b)) / max(1, len(tokens)))  # delimiters
        rows[i, 8] = bool(_MARK.match(b))  # list mark
        rows[i, 9] = len(_MIXED.findall(b)) / max(4, len(tokens)) if len(b) else 0  # odd case and letters among digits
        rows[i, 9] = min(1.5, rows[i, 9])
        pairs = _pairs(b) if latin >= 8 and not foreign else ()
        rows[i, 10] = min(4.0, max(-0.5, float(bits[pairs].mean()) - usual)) if len(pairs) else 0.0  # surprise of its letter pairs
        rows[i, 11] = 0.0 if cjk or foreign else sum(len(w) == 1 for w in words) / count  # single letters
        rows[i, 12] = sum(bool(_NUMERIC.match(t)) for t in tokens) / max(1, len(tokens))  # numbers among tokens
        short.append(count < 7 and not rows[i, 6])
    run = np.zeros(len(part), np.int64)
    at = 0
    for i in range(len(part) + 1):
        if i == len(part) or not short[i]:
            run[at:i] = i - at
            at = i + 1
    rows[:, 13] = np.log1p(np.minimum(run, 20))  # run of short blocks
    return rows


def example_features(common: set[str], letters: tuple[np.ndarray, float]) -> list[np.ndarray]:
    """Statistics of the examples of each component. Entries of lists stand in runs, as they do in documents."""
    found = []
    for _, name, texts in EXAMPLES:
        rows = [block_features(blocks(t), common, letters) for t in texts]
        if name == "list entries":
            rows = [block_features(texts, common, letters)]
        found.append(np.concatenate(rows))
    return found


def block_table(docs: DataFrame, common: set[str], letters: tuple[np.ndarray, float], least_chars: int = 1) -> DataFrame:
    """(id, chars, stats array<float>): a row for each block of (id, text); documents under ``least_chars`` characters have none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 300):
                part = batch.slice(lo, 300)
                ids, chars, rows = [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text is None or len(text) < least_chars or not (bs := blocks(text)):
                        continue
                    ids += [key] * len(bs)
                    chars += map(len, bs)
                    rows.append(block_features(bs, common, letters))
                if ids:
                    x = np.concatenate(rows)
                    offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * N_FEATURES)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(chars, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["id", "chars", "stats"])

    return docs.select("id", "text").where("id is not null").mapInArrow(run, "id long, chars long, stats array<float>")


def _log_density(x: np.ndarray, model: dict) -> np.ndarray:
    """Log of weight times density, a column for each component; all whitened in one product."""
    k = len(model["weight"])
    y = x @ model["white"] - model["shift"]
    y *= y
    return model["const"] - 0.5 * y.reshape(len(x), k, N_FEATURES).sum(2)


def _shares(x: np.ndarray, model: dict) -> tuple[np.ndarray, float]:
    """Each component's share of each row, and the log likelihood of all rows."""
    log = _log_density(x, model)
    top = log.max(1, keepdims=True)
    p = np.exp(log - top)
    whole = p.sum(1, keepdims=True)
    return p / whole, float((top + np.log(whole)).sum())


def _matrix(column) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(-1, N_FEATURES)


def _summed(blocks_: DataFrame, function, length: int) -> np.ndarray:
    """Sum over all blocks of the vector that ``function`` gives for a matrix of statistics; one row a task reaches the driver."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                total += function(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tolist()])], ["one", "v"])

    parts = blocks_.select("stats").mapInArrow(run, "one long, v array<double>").select(F.posexplode("v").alias("i", "x"))
    total = np.zeros(length)
    for i, x in parts.groupBy("i").agg(F.sum("x")).collect():  # ``length`` numbers
        total[i] = x
    return total


def fit_mixture(blocks_: DataFrame, common: set[str], letters: tuple[np.ndarray, float], rounds: int = ROUNDS) -> dict:
    """A Gaussian mixture of the standardised statistics of all blocks, by expectation-maximisation.

    Each round is one pass in which tasks sum the moments of their blocks. There is a component for each set of examples,
    which starts at their mean; the examples stay in the sums with 0.4 % of the weight of all blocks each, so that a
    component keeps its meaning. Rounds end when one gains less than LEAST_GAIN nats a block. An empty table leaves the components where the examples put them.
    """
    d, k = N_FEATURES, len(EXAMPLES)
    moments = _summed(blocks_, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    shown = example_features(common, letters)
    n = moments[0]
    if n:
        centre = moments[1 : 1 + d] / n
        scale = np.sqrt(np.maximum(moments[1 + d :] / n - centre**2, 0))
    else:
        every = np.concatenate(shown)
        centre, scale = every.mean(0), every.std(0)
    scale = np.maximum(scale, 0.05)
    shown = [(x - centre) / scale for x in shown]
    prior = max(1.0, PRIOR_SHARE * n)

    upper = np.triu_indices(d)

    def moved(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Sums of weights, of statistics and of their products (the upper half), by component."""
        return np.concatenate([r.sum(0), (r.T @ x).ravel(), (r.T @ (x[:, upper[0]] * x[:, upper[1]])).ravel()])

    base = np.zeros(k + k * d + k * len(upper[0]))
    for j, x in enumerate(shown):
        r = np.zeros((len(x), k))
        r[:, j] = prior / len(x)
        base += moved(x, r)

    def model_of(total: np.ndarray) -> dict:
        weight, first, second = total[:k], total[k : k + k * d].reshape(k, d), np.empty((k, d, d))
        half = total[k + k * d :].reshape(k, -1)
        second[:, upper[0], upper[1]] = half
        second[:, upper[1], upper[0]] = half
        mean = first / weight[:, None]
        cov = second / weight[:, None, None] - np.einsum("ki,kj->kij", mean, mean) + FLOOR * np.eye(d)
        chol = np.linalg.cholesky(cov)
        white = np.linalg.inv(chol)
        const = np.log(weight / weight.sum()) - np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(1)
        return {"weight": weight, "white": white.reshape(k * d, d).T.copy(), "shift": np.einsum("kij,kj->ki", white, mean).ravel(), "const": const, "centre": centre, "scale": scale}

    model, before = model_of(base), -np.inf
    for _ in range(rounds if n else 0):
        now = model

        def step(x: np.ndarray, now=now) -> np.ndarray:
            z = (x - centre) / scale
            out = 0
            for lo in range(0, len(z), 20_000):
                part = z[lo : lo + 20_000]
                shares, likelihood = _shares(part, now)
                out = out + np.append(moved(part, shares), likelihood)
            return out

        total = _summed(blocks_, step, len(base) + 1)
        model = model_of(base + total[:-1])
        if total[-1] - before < LEAST_GAIN * n:
            break
        before = total[-1]
    return model


def document_kinds(docs: DataFrame, words: DataFrame, least_chars: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """(id, chars, prose, other, list, table, log, data, junk): characters of each document (id, text) by kind of block.

    A block's characters go to the kind of the component it most probably belongs to. Repeated rows count once. ``words`` (word) are
    the common words, at most 100,000 of them (more raise an error). Null and blank texts and texts under ``least_chars`` have no row.
    """
    common = set(word_list(words, MOST_WORDS))
    letters = fit_letters(docs)
    hold = Scratch()
    blocks_ = hold(block_table(docs, common, letters, least_chars), "blocks")
    model = fit_mixture(blocks_, common, letters, rounds)
    kinds = sorted(set(KINDS))
    column = np.array([kinds.index(x) for x in KINDS])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            p = _shares((_matrix(batch.column(2)) - model["centre"]) / model["scale"], model)[0]
            of_kind = np.stack([p[:, column == j].sum(1) for j in range(len(kinds))], 1).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of_kind.astype(np.int32))], ["id", "chars", "kind"])

    rows = blocks_.mapInArrow(run, "id long, chars long, kind int")
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == j, F.col("chars"))), F.lit(0)).alias(x) for j, x in enumerate(kinds)]
    found = written(rows.groupBy("id").agg(F.sum("chars").alias("chars"), *sums), "kinds")
    hold.discard()
    return found


def not_prose(docs: DataFrame, words: DataFrame, least_chars: int = 100) -> DataFrame:
    """Ids of the documents of at least ``least_chars`` characters of which more than half stand in blocks of lists, tables, logs, data or junk."""
    kinds = document_kinds(docs, words, least_chars)
    return kinds.where(F.col("list") + F.col("table") + F.col("log") + F.col("data") + F.col("junk") > 0.5 * F.col("chars")).select("id")


def statistics(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(id, words, mean_word_length, symbol_share, punctuated_lines, common_share) of each document (id, text), once.

    words: runs of letters and digits. symbol_share: characters other than letters, digits and blanks. punctuated_lines: of the lines
    with text, those that end in . ! ? or …. Null and blank texts have 0 words and null shares.
    """
    text = F.coalesce("text", F.lit(""))
    ws = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"[\s\x{a0}]", "") != "")
    n, solid = F.size("ws"), F.length(F.regexp_replace(text, r"[\s\x{a0}]", ""))
    common = word_list(words, MOST_WORDS)
    return (
        docs.select("id", "text").distinct()
        .select("id", ws.alias("ws"), lines.alias("lines"), solid.alias("solid"), F.length(F.regexp_replace(text, r"[\s\x{a0}\p{L}\p{N}]", "")).alias("symbols"))
        .select(
            "id", n.cast("long").alias("words"),
            F.round(F.aggregate("ws", F.lit(0), lambda a, x: a + F.length(x)) / F.nullif(n, F.lit(0)), 6).alias("mean_word_length"),
            F.round(F.col("symbols") / F.nullif(F.col("solid"), F.lit(0)), 6).alias("symbol_share"),
            F.round(F.size(F.filter("lines", lambda x: x.rlike(r"[.!?…][\s\x{a0}]*$"))) / F.nullif(F.size("lines"), F.lit(0)), 6).alias("punctuated_lines"),
            F.round(F.size(F.filter("ws", lambda x: x.isin(common) if common else F.lit(False))) / F.nullif(n, F.lit(0)), 6).alias("common_share"),
        )
    )

"""Template residue, filler, error pages and script notices: positive-unlabelled naive Bayes.

A text falls into passages (lines and sentences). Passages with marks that only unfilled templates, filler,
error pages or script notices have are trusted positives; all others are unlabelled. A naive Bayes
model of two classes is fitted by expectation-maximization: trusted passages stay positive, the others
take the probability that the model gives them. It is fitted on a bounded sample of records, whose passages are counted and weighed
by Spark round by round; every passage of every record is scored, and a record is found if one of its passages is.

Features are words (runs of two characters where a script has no blanks), the kind of
place-holder if there is one, and the passage's form. They are hashed, so that the model has one size.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table

FEATURES = 1 << 18
#: The model is fitted on about so many records at most, chosen by a hash of their id.
FIT_RECORDS = 20_000
ROUNDS = 2
#: A passage is residue from these log odds on.
THRESHOLD = 0.0
#: Log odds before a passage is read. It isn't learnt: what is rare but harmless would draw the model to itself.
PRIOR = -6.0
#: Log odds of a trusted passage at least.
SURE = 10.0
#: Smoothing of counts, and the most that one feature may add to the log odds.
SMOOTHING, MOST = 0.2, 5.0

# Places left to be filled in, by their notation.
PLACES = tuple(
    re.compile(p, re.I)
    for p in (
        r"\{\{[^{}\n]+\}\}",
        r"\{%[^{}%\n]+%\}",
        r"<%[=\-]?[^<>%\n]+%>",
        r"<\?=?[^<>?\n]+\?>",
        r"\$\{[^{}\n]+\}",
        r"\[%[^\[\]%\n]+%\]",
        r"\[\[(?!see\b)[a-z][\w.\- ]+\]\]",
        r"%\([\w.]+\)[sd]",
        r"(?<![\w%])%[a-z][\w.]{2,}%(?!\w)",
        r"(?<!\w)\$[a-z][a-z_.]{2,}\$(?!\w)",
        r"@@\w[\w.]+@@",
        r"\#\#\w[\w.]+\#\#",
        r"(?<!\w)(?-i:__[A-Z][A-Z_.]{2,}__)(?!\w)",
        r"«\s*[a-z][\w.]+\s*»|<<\s*[a-z][\w.]+\s*>>",
        r"(?<!\w)XX[./-]XX[./-](?:20)?XX(?:XX)?(?!\w)",
        r"\[object Object\]|\(\s*null\s*\)|<undefined>",
        r"\{\d\}\s*/\s*\{\d\}",
        r"_{4,}|＿{3,}|\.{8,}|…{3,}",
        r"(?<!\w)(?:DD|TT|JJ|MM)[./\-](?:MM|DD|JJ)[./\-](?:YYYY|JJJJ|AAAA|YY)(?!\w)|(?<!\w)(?:YYYY|JJJJ|AAAA)-MM-(?:DD|TT|JJ)(?!\w)|[xX×]{2,4}年[xX×]{1,2}月",
        r"[\[<(（【〈《]\s*(?:insert|enter|your|add|fill in|type|choose|select|specify|name of|to be (?:completed|confirmed|defined|added|inserted)|tb[adc]|todo|placeholder|bitte|hier|ihr|einfügen|eintragen|platzhalter|insérer|indiquer|à (?:compléter|remplir|préciser)|votre|escriba|inserte|insertar|completar|indique|por (?:completar|definir)|su|请|填写|待|此处|插入|在此)\b[^\]>)）】〉》\n]*[\]>)）】〉》]",
        r"[\[<(（【〈《]\s*(?:请|填写|待|此处|插入|在此|输入|占位)[^\]>)）】〉》\n]*[\]>)）】〉》]",
        r"[\[<(（【〈《][^\[\]<>()（）\n]+?(?:[–—-]\s*(?:pending|tbd|open|offen|pendiente|en attente|待定)|:\s*(?:tbd|tba|tbc|todo|xxx)|\b(?:goes here|to be (?:inserted|completed|confirmed|added|defined)|einfügen|ergänzen|eintragen|à compléter|ici|aquí|pendiente)|待定|待填|待补充|填写)\s*[\]>)）】〉》]",
        r"\[(?:dummy|placeholder|blank|xxx+|tbd|tbc|todo|empty|your text|text|name|date|image|logo)\]",
    )
)

#: What each of them needs at least: one of these characters, a run of dots, or letters of a date before its mark.
_OPEN = re.compile(r"[\[\]{}<>$%@#_(（【/年«〈《]")
_DATE = re.compile(r"[./\-](?<=[DTJMXYAdtjmxya]{2}[./\-])")

# Passages that are trusted, in lower case: messages of failed pages and programs, notices on scripts, filler.
TRUSTED = tuple(
    re.compile(p)
    for p in (
        r"^\W*(?:error|fehler|erreur|错误|http)\W{0,3}[45]\d\d\b",
        r"^\W*[45]\d\d\W{1,4}(?:bad gateway|not found|forbidden|page not found|internal server|service unavailable|gateway|unauthorized|gone|too many requests|bad request)\b",
        r"^\W*(?:the|this|our) (?:service|site|page|portal|server) is (?:temporarily |currently |not )?(?:unavailable|down|offline|available)\b",
        r"^\W*(?:fatal error|unhandled exception|internal failure while|uncaught \w+error)\b|^\W*file \"[^\"]+\", line \d+|^\W*(?:key|type|value|name|index)error\b|nullreference|nullpointer",
        r"^\W*some example (?:text|wording)\b|^\W*content coming soon\b|^\W*blindtext\W*$",
        r"^\W*(?:bad gateway|404 not found|page not found|access denied|forbidden|internal server error|service unavailable|gateway time-?out)\W*$",
        r"^\W*traceback \(most recent call last\)",
        r"^\W*(?:please )?(?:enable|activate|allow|turn on) (?:java)?scripts?\b",
        r"\b(?:requires?|needs?|relies on|without|cannot start without|does not work without)\b.*\b(?:javascript|scripting|scripts|js)\W*$",
        r"^\W*noscript\b|\byour browser (?:blocks|does not)|navigateur (?:les )?bloque|habilite javascript|active javascript|activez javascript|ohne (?:java)?s[ck]ripte?\b|javascript (?:aktivieren|einschalten)|请(?:启用|开启|打开).{0,6}(?:javascript|脚本)",
        r"^\W*(?:sorry, )?(?:this|that|the) (?:page|address|site|document|file) (?:you asked for )?(?:could not be found|is no longer available|cannot be found|was not found|does not exist)",
        r"^\W*something went wrong\b|^\W*(?:please )?try again later\W*$",
        r"^\W*lorem ipsum dolor\b|^\W*(?:your|sample|dummy) text(?: here)?\W*$|^\W*text text text\W*$|^\W*this is dummy copy\b|^\W*body copy to follow\W*$",
        r"^\W*(?:(?:asdf|foo|bar|blah|test|xxx)\b\W*){4,}$",
        r"(?:seite|dokument) wurde nicht gefunden|page (?:est )?introuvable|página no (?:se encuentra|encontrada)|找不到(?:页面|网页|该页)|页面不存在",
    )
)

#: One of these is in every passage that one of them fits.
_SIGNS = (
    "error", "fehler", "erreur", "错误", "http", "gateway", "not found", "forbidden", "internal s", "service", "unauthorized", "gone", "too many", "bad request",
    "unavailable", "offline", "available", " down", "exception", "internal failure", "line ", "nullreference", "nullpointer", "some example", "coming soon", "blindtext",
    "access denied", "time", "traceback", "script", "skript", "js", "your browser", "bloque", "脚本", "could not be", "no longer", "cannot be", "was not", "does not exist",
    "went wrong", "try again", "lorem ipsum", "text", "dummy copy", "to follow", "asdf", "foo", "bar", "blah", "test", "xxx", "nicht gefunden", "introuvable", "no se encuentra",
    "no encontrada", "找不到", "不存在",
)
_tools: dict[str, object] = {}

#: Trusted from the start, so that a small collection has a model, too.
SEEDS = (
    "Error 404: Page not found", "Error 503: Service unavailable", "Error 500: Internal server error", "Bad Gateway", "Access denied.", "Try again later.",
    "Sorry, this page is no longer available.", "The page you asked for could not be found.", "You do not have permission to view this page.", "Please sign in to continue.",
    "Something went wrong on our side. Please try again later.", "The connection timed out.", "The server did not answer in time.", "Check the address and reload the page.",
    "Traceback (most recent call last):", "NullPointerException at line 12", "Fatal error: uncaught exception", "Database connection failed: timeout", "Go back to the start page.",
    "Die Seite wurde nicht gefunden.", "Bitte später erneut versuchen.", "Zugriff verweigert.", "Interner Serverfehler", "La page est introuvable.", "Accès refusé.", "Réessayez plus tard.",
    "La página no se encuentra.", "Acceso denegado.", "Inténtelo de nuevo más tarde.", "找不到页面。", "拒绝访问。", "请稍后再试。", "服务器内部错误",
    "Please enable JavaScript to view this page.", "This site requires JavaScript.", "Your browser does not support scripts.", "Turn on scripts and reload the page.", "Check your browser settings.",
    "Bitte aktivieren Sie JavaScript.", "Ohne Skripte kann die Seite nicht angezeigt werden.", "Veuillez activer JavaScript.", "Active JavaScript en su navegador.", "请启用JavaScript以查看此页面。", "您的浏览器不支持脚本。",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Sed do eiusmod tempor incididunt ut labore.", "Your text here.", "Sample text.", "Text to follow.", "This is dummy text.", "Blindtext", "Hier steht Ihr Text.",
    "Texte à venir.", "Texto de ejemplo.", "示例文本。", "此处填写内容。", "asdf asdf foo bar blah blah test test", "xxx xxx xxx",
)

_LOOKALIKE = str.maketrans("аеорсухіѕјԁһԛԝАВЕКМНОРСТХαοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxisjdhqwABEKMHOPCTXaoABEZHIKMNOPTYX")
_CUT = re.compile(r"[\r\n\u0085  ]+|(?<=[.!?;…])[\"'”’»)]*\s+|(?<=[。！？；])")
_BLOB = re.compile(r"(?=\S*\d)(?=\S*[A-Za-z])[\w+/=\-]{32,}", re.A)
_WORD = re.compile(r"[^\W_]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯]+")


_UNSEEN = regex.compile(r"\p{Cf}+")
_LETTER = re.compile("[a-z]")
_LONG = re.compile(r"\S{32}")


def passages(text: str) -> list[str]:
    """Lines and sentences, with compatible forms, look-alike letters and invisible characters made plain."""
    plain = text.isascii()
    if not plain:
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    out = []
    for part in _CUT.split(text):
        part = " ".join(part.split())
        if part:
            out.append(part.translate(_LOOKALIKE) if not plain and not part.isascii() and _LETTER.search(part) else part)
    return out


def has_sign(lower: str) -> bool:
    """Whether a text in lower case has what every trusted passage has."""
    if "signs" not in _tools:
        signs = ahocorasick.Automaton()
        for sign in _SIGNS:
            signs.add_word(sign, True)
        signs.make_automaton()
        _tools["signs"] = signs
    return next(_tools["signs"].iter(lower), None) is not None


def is_trusted(passage: str) -> bool:
    lower = passage.lower()
    return has_sign(lower) and any(p.search(lower) for p in TRUSTED)


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (FEATURES - 1)


def _bare(passage: str) -> tuple[str, bool]:
    """The passage without places to be filled in and without codes, and whether it has such a place."""
    bare, place = passage, False
    if len(passage) >= 32 and _LONG.search(passage):
        bare = _BLOB.sub(" ", passage)
    if _OPEN.search(passage) or _DATE.search(passage) or "........" in passage:
        for pattern in PLACES:
            bare, n = pattern.subn(" ", bare)
            place = place or n > 0
    return bare, place


def _names(word: str) -> list[str]:
    """The features of a word in lower case."""
    if _WIDE.match(word):
        return [run[i : i + 2] for run in _WIDE.findall(word) for i in range(max(1, len(run) - 1))]
    if word.isdigit():
        return ["§number"]
    return ["§code"] if len(word) > 24 or any(c.isdigit() for c in word) else [word]


def features(passage: str, cache: dict[str, list[int]]) -> tuple[list[int], bool]:
    """The hashed features of a passage, and whether it has a place to be filled in."""
    bare, place = _bare(passage)
    out = {_hash("§place")} if place else set()
    for word in set(_WORD.findall(bare.lower())):
        if word not in cache:
            cache[word] = [_hash(n) for n in _names(word)]
        out.update(cache[word])
    return sorted(out) or [_hash("§empty")], place


#: Features that say nothing by themselves.
_FORMS = ("§number", "§code", "§empty")


class Scores(dict):
    """The log odds that a word adds, each looked up once."""

    def __init__(self, weight: np.ndarray):
        super().__init__()
        self.weight = weight

    def __missing__(self, word: str) -> float:
        value = sum(float(self.weight[i]) for i in {_hash(n) for n in _names(word)})
        if len(self) > 500_000:
            self.clear()
        self[word] = value
        return value

    def odds(self, passage: str) -> tuple[float, bool]:
        """The log odds of a passage, and whether it has a place to be filled in. A feature counts once."""
        bare, place = _bare(passage)
        words = set(_WORD.findall(bare.lower()))
        if not bare.isascii() and _WIDE.search(bare):  # words may share features
            own = {_hash(n) for w in words for n in _names(w)}
            total = sum(float(self.weight[i]) for i in own)
        else:
            total = sum(map(self.__getitem__, words))
        return PRIOR + total + (float(self.weight[_hash("§place")]) if place else 0.0), place


def weights_of(good: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The log odds of each feature from how often it stands in residue and elsewhere (the M step)."""
    used = max(1, int(((good + other) > 0).sum()))
    p = (good + SMOOTHING) / (good.sum() + SMOOTHING * used)
    q = (other + SMOOTHING) / (other.sum() + SMOOTHING * used)
    weight = np.clip(np.log(p / q), -MOST, MOST)
    weight[[_hash(n) for n in _FORMS]] = 0.0
    return weight


def counted(features_: pa.ListArray, n: np.ndarray, trusted: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """How often each feature stands in residue and elsewhere, passages by the chance that they are residue (the E step)."""
    flat, edges = features_.flatten().to_numpy(), features_.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0] if len(edges) else edges
    chance = trusted.astype(float)
    if weight is not None and len(flat):
        odds = PRIOR + np.add.reduceat(weight[flat], edges[:-1])
        chance = np.where(trusted, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    of = np.repeat(np.arange(len(n)), np.diff(edges))
    return np.bincount(flat, (chance * n)[of], FEATURES), np.bincount(flat, ((1 - chance) * n)[of], FEATURES)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of records, those that differ in digits only as one: (alike, n, features, trusted)."""
    cache: dict[str, list[int]] = {}
    for batch in batches:
        counts: dict[str, tuple[int, str]] = {}
        for text in batch.column("text").to_pylist():
            for passage in passages(text):
                alike = re.sub(r"\d", "0", passage)
                n, first = counts.get(alike, (0, passage))
                counts[alike] = (n + 1, min(first, passage))
        read = [(features(p, cache), is_trusted(p)) for _, p in counts.values()]
        columns = [
            pa.array([int.from_bytes(hashlib.blake2b(a.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for a in counts], pa.int64()),
            pa.array([n for n, _ in counts.values()], pa.int64()), pa.array([f for (f, _), _ in read], pa.list_(pa.int32())), pa.array([place or sure for (_, place), sure in read], pa.bool_()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["alike", "n", "features", "trusted"])


def fit(sample: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Expectation-maximization over passages ``(n, features, trusted)``: the log odds of each feature.

    Each round every task adds up the features of its passages; at most ``FEATURES`` sums come to the driver.
    """
    cache: dict[str, list[int]] = {}
    seeds = pa.array([features(p, cache)[0] for p in SEEDS], pa.list_(pa.int32()))
    sure = counted(seeds, np.ones(len(SEEDS)), np.ones(len(SEEDS), bool), None)[0]
    weight: np.ndarray | None = None
    for _ in range(rounds):
        now = weight

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            good, other = np.zeros(FEATURES), np.zeros(FEATURES)
            for batch in batches:
                own = counted(batch.column("features"), batch.column("n").to_numpy(), batch.column("trusted").to_numpy(zero_copy_only=False), now)
                good, other = good + own[0], other + own[1]
            at = np.flatnonzero(good + other)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(good[at]), pa.array(other[at])], ["feature", "good", "other"])

        sums = sample.select("n", "features", "trusted").mapInArrow(add, "feature bigint, good double, other double")
        sums = sums.groupBy("feature").agg(F.sum("good").alias("good"), F.sum("other").alias("other")).toArrow()
        good, other, at = sure.copy(), np.zeros(FEATURES), sums.column("feature").to_numpy()
        # sums of parts in whatever order, rounded to be the same each time
        good[at] += np.round(sums.column("good").to_numpy(), 6)
        other[at] += np.round(sums.column("other").to_numpy(), 6)
        weight = weights_of(good, other)
    return weight


def residue_scores(df: DataFrame, id_col: str, text_col: str, fit_records: int = FIT_RECORDS, rounds: int = ROUNDS) -> DataFrame:
    """``(id_col, odds, passage_count, residue_count)`` of each record with text: the highest log odds of its passages.

    Null texts give no row; empty and blank ones have no passages and null odds. Rows that repeat an id give a row
    each. The model is fitted on the records whose hashed id falls below ``fit_records`` of the number of
    records; scoring reads all records and whole texts.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    total = rows.count()
    part = min(1.0, fit_records / max(1, total))
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))) if part < 1 else rows
    alike = chosen.select("text").mapInArrow(_sample, "alike bigint, n bigint, features array<int>, trusted boolean")
    sample = staged(alike.groupBy("alike").agg(F.sum("n").alias("n"), F.min("features").alias("features"), F.max("trusted").alias("trusted")), "passages")
    shared = df.sparkSession.sparkContext.broadcast(fit(sample, rounds).astype(np.float32))
    key = dict(rows.dtypes)["id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scores(shared.value)
        for batch in batches:
            odds, counts, found = [], [], []
            for text in batch.column("text").to_pylist():
                parts = passages(text)
                some = has_sign(text.lower() if text.isascii() else " ".join(parts).lower())
                values = []
                for passage in parts:
                    value, place = own.odds(passage)
                    # labelled passages keep their label
                    values.append(max(value, SURE) if place or some and is_trusted(passage) else value)
                odds.append(round(max(values), 6) if values else None)
                counts.append(len(values))
                found.append(sum(v >= THRESHOLD for v in values))
            columns = [batch.column("id"), pa.array(odds, pa.float64()), pa.array(counts, pa.int64()), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "odds", "passage_count", "residue_count"])

    return rows.mapInArrow(score, f"`{id_col}` {key}, odds double, passage_count bigint, residue_count bigint")


def p10_found(spark, sf_dir: str) -> DataFrame:
    """The documents with residue."""
    return residue_scores(table(spark, sf_dir, "documents"), "doc_id", "text").where("residue_count > 0").select("doc_id")


def p10_kept(spark, sf_dir: str) -> DataFrame:
    """The corpus without them, by collection: documents kept and left out. Documents without text are kept."""
    docs = table(spark, sf_dir, "documents")
    scores = residue_scores(docs, "doc_id", "text").where("residue_count > 0").select("doc_id", F.lit(1).alias("out"))
    joined = docs.select("doc_id", "source").join(scores, "doc_id", "left")
    return joined.groupBy("source").agg(F.count(F.when(F.col("out").isNull(), 1)).alias("kept"), F.count("out").alias("left_out"))


QUERIES = {"p10_found": p10_found, "p10_kept": p10_kept}
SQL: dict[str, str] = {}

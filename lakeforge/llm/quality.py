"""Quality rules, line first: bad lines go, then documents that lost too much text.

Every line is judged by itself. It is bad by

* punctuation: over MARK_PERCENT percent of its visible characters are marks (runs of exclamation and
  question marks count where there are LOUD or more), or it has END_WORDS words or more and no mark that ends
  or divides a sentence,
* navigation: it has at least NAV_BARS separators, one for every four words or more (menus, breadcrumbs, lists in a row),
  or at most MENU_WORDS words, two or more and half of them or more from MENU,
* boilerplate: it holds one of PHRASES (A-Z in either case).

A document is rejected if the base rules fail it, or if the lines removed held more than half
of its words. All counts are over whole texts; the state is that of one document at a time.

Null or empty text: no words, so base_failed. Repeated rows, and null ids, are judged row by
row. Columns beyond doc_id and text are carried in a struct and may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from .common import LEADS, SPACE, binary_parts, byte_set, map_arrow, sums_between, text_bytes

SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&<>=_~^"
MARK_PERCENT = 10
LOUD = 3
END_WORDS = 8
ENDS = ".!?:;\u2026\u3002\uff01\uff1f"
NAV_BARS = 3
BARS = "|\u00bb\u203a\u2022\u00b7\u2192"
MENU_WORDS = 12
#: Words of menus in English, German, French and Spanish.
MENU = (
    "home", "login", "logout", "register", "sitemap", "contact", "imprint", "about", "search", "menu", "next", "previous", "back", "share", "subscribe", "faq",
    "startseite", "anmelden", "abmelden", "registrieren", "kontakt", "impressum", "datenschutz", "suche", "weiter", "hilfe",
    "accueil", "connexion", "inscription", "recherche", "suivant", "retour", "aide", "partager",
    "inicio", "entrar", "registrarse", "contacto", "buscar", "siguiente", "anterior", "volver", "ayuda", "compartir",
)
_STRIPPED = ".,:;!?|"
PHRASES = (
    "all rights reserved", "licensed under the", "is licensed under", "released under the", "terms of service", "terms of use", "privacy policy", "cookie policy",
    "accept all cookies", "enable javascript", "lorem ipsum", "click here to", "sign up for our", "subscribe to our",
    "alle rechte vorbehalten", "allgemeine gesch\u00e4ftsbedingungen", "cookies akzeptieren", "javascript aktivieren", "klicken sie hier", "newsletter abonnieren",
    "tous droits r\u00e9serv\u00e9s", "conditions d'utilisation", "politique de confidentialit\u00e9", "accepter les cookies", "cliquez ici",
    "todos los derechos reservados", "t\u00e9rminos de uso", "pol\u00edtica de privacidad", "pol\u00edtica de cookies", "aceptar las cookies", "haga clic aqu\u00ed",
)
MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long, n_lost_lines long"
_PHRASES = tuple(x.encode() for x in PHRASES)
_VISIBLE = LEADS & ~byte_set(SPACE)
_SYMBOL = byte_set(SYMBOLS)
_NOT_MARK = bytes(sorted(set(range(256)) - set(MARKS.encode())))
_TRAILS = bytes(range(0x80, 0xC0))
_LOUD = re.compile(rb"[!?]{2,}")
_ENDS, _BARS, _MENU = [x.encode() for x in ENDS], [x.encode() for x in BARS], {x.encode() for x in MENU}


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` (a power of two) words that occur twice or more.

    Windows are ranked by doubling: a window of 2k words is the pair of ranks of its halves,
    so ranks are exact and no window is hashed.
    """
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    span, distinct = 1, len(seen)
    while span < width:
        pairs = rank[:-span] * distinct + rank[span:]
        values, rank, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(values) == len(pairs):
            return 0
        distinct, span = len(values), span * 2
    edges = np.zeros(n + 1, np.int64)
    twice = np.flatnonzero(counts[rank] > 1)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + width, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def bad_line(line: bytes) -> bool:
    words = line.split()
    n, low = len(words), line.lower()
    visible = len(b"".join(words).translate(None, _TRAILS))
    loud = _LOUD.findall(line)
    marks = len(line.translate(None, _NOT_MARK)) + (sum(map(len, loud)) if len(loud) >= LOUD else 0)
    if 100 * marks > MARK_PERCENT * visible or (n >= END_WORDS and not any(x in line for x in _ENDS)):
        return True
    bars = sum(line.count(x) for x in _BARS)
    if bars >= NAV_BARS and 4 * bars >= n:
        return True
    menu = sum(w.strip(_STRIPPED.encode()) in _MENU for w in low.split()) if n <= MENU_WORDS else 0
    return (menu >= 2 and 2 * menu >= n) or any(p in low for p in _PHRASES)


def judge(text: bytes) -> tuple[int, int, int, int, bool, bool, list[bytes] | None]:
    """(words, duplicate lines, repeated words, lost words, base_failed, kept, lines that stay; None: all)"""
    words = text.split()
    n = len(words)
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    duplicates = len(full) - len(set(full))
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n
    bad = {x for x in set(full) if bad_line(x)}
    lost = sum(len(x.split()) for x in full if x in bad) if bad else 0
    return n, duplicates, repeats, lost, failed, not failed and 2 * lost <= n, [x for x in lines if x not in bad] if bad else None


def score(docs: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, FIELDS, the cleaned text, and a struct ``row`` of the columns of ``keep`` if there are any."""
    row = [F.struct(*(docs[c] for c in keep)).alias("row")] if keep else []
    chosen = docs.select("doc_id", *row, text_bytes().alias("text"))
    shape = StructType([*chosen.schema.fields[:-1], *(StructField(n, LongType() if t == "long" else BooleanType()) for n, t in (x.split() for x in FIELDS.split(", "))), StructField("cleaned", BinaryType())])

    def run(batches):
        for b in batches:
            text = b.column(b.num_columns - 1)
            raw, at = binary_parts(text)
            rows = [judge(x) for x in text.to_pylist()]
            n, dup, rep, lost, failed, kept, stay = zip(*rows, strict=True) if rows else [[]] * 7
            cleaned = [x.as_py() if s is None else b"\n".join(s) for x, s in zip(text, stay, strict=True)]
            gone = [0 if s is None else x.count(b"\n") + 1 - len(s) for x, s in zip(text.to_pylist(), stay, strict=True)]
            longs = [n, sums_between(_VISIBLE[raw], at), sums_between(_SYMBOL[raw], at), dup, rep]
            columns = [*b.columns[:-1], *(pa.array(x, pa.int64()) for x in longs), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(lost, pa.int64()), pa.array(gone, pa.int64()), pa.array(cleaned, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, shape.names)

    return map_arrow(chosen, run, shape)


def clean(docs: DataFrame) -> DataFrame:
    """Documents that pass, without their bad lines and with n_chars to match, in the columns of ``docs``."""
    done = score(docs, keep=tuple(c for c in docs.columns if c != "text")).where("kept")
    text = F.col("cleaned").cast("string")
    made = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return done.select(*(made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in docs.columns))

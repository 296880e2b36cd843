"""Text functions: splits, composition, search, prompts, repetition checks."""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from cuelake.functions.timecode import div

#: Phrases that recognisers make up in silence.
MADE_UP_PHRASES = (
    "ghiền mì gõ",
    "đăng ký kênh",
    "subscribe cho kênh",
    "nhấn chuông thông báo",
    "cảm ơn các bạn đã xem",
    "hẹn gặp lại các bạn",
    "đừng quên like",
    "đừng quên đăng ký",
    "thanks for watching",
    "thank you for watching",
    "subscribe to my channel",
    "see you next time",
    "see you in the next video",
    "don't forget to subscribe",
    "like and subscribe",
    "[music]",
    "[applause]",
    "[laughter]",
    "♪",
    "♫",
    "ご視聴ありがとうございました",
    "字幕",
    "다음 영상에서",
)
#: Codes and names of languages, then the translation model's codes.
LANGUAGES = (
    ("vi", "Vietnamese", "vie_Latn"),
    ("en", "English", "eng_Latn"),
    ("zh", "Chinese", "zho_Hans"),
    ("ja", "Japanese", "jpn_Jpan"),
    ("ko", "Korean", "kor_Hang"),
    ("fr", "French", "fra_Latn"),
    ("de", "German", "deu_Latn"),
    ("es", "Spanish", "spa_Latn"),
    ("pt", "Portuguese", "por_Latn"),
    ("ru", "Russian", "rus_Cyrl"),
    ("th", "Thai", "tha_Thai"),
    ("id", "Indonesian", "ind_Latn"),
    ("ar", "Arabic", "arb_Arab"),
    ("hi", "Hindi", "hin_Deva"),
    ("bn", "Bengali", "ben_Beng"),
    ("ms", "Malay", "zsm_Latn"),
    ("tl", "Filipino", "tgl_Latn"),
    ("my", "Burmese", "mya_Mymr"),
    ("km", "Khmer", "khm_Khmr"),
    ("lo", "Lao", "lao_Laoo"),
    ("it", "Italian", "ita_Latn"),
    ("nl", "Dutch", "nld_Latn"),
    ("pl", "Polish", "pol_Latn"),
    ("uk", "Ukrainian", "ukr_Cyrl"),
    ("cs", "Czech", "ces_Latn"),
    ("sv", "Swedish", "swe_Latn"),
    ("da", "Danish", "dan_Latn"),
    ("fi", "Finnish", "fin_Latn"),
    ("no", "Norwegian", "nob_Latn"),
    ("el", "Greek", "ell_Grek"),
    ("tr", "Turkish", "tur_Latn"),
    ("he", "Hebrew", "heb_Hebr"),
    ("fa", "Persian", "pes_Arab"),
    ("hu", "Hungarian", "hun_Latn"),
    ("ro", "Romanian", "ron_Latn"),
    ("bg", "Bulgarian", "bul_Cyrl"),
    ("hr", "Croatian", "hrv_Latn"),
    ("sk", "Slovak", "slk_Latn"),
    ("sl", "Slovenian", "slv_Latn"),
    ("lt", "Lithuanian", "lit_Latn"),
    ("lv", "Latvian", "lvs_Latn"),
    ("et", "Estonian", "est_Latn"),
    ("ca", "Catalan", "cat_Latn"),
    ("gl", "Galician", "glg_Latn"),
    ("eu", "Basque", "eus_Latn"),
    ("af", "Afrikaans", "afr_Latn"),
    ("sw", "Swahili", "swh_Latn"),
    ("ta", "Tamil", "tam_Taml"),
    ("te", "Telugu", "tel_Telu"),
    ("ur", "Urdu", "urd_Arab"),
    ("ne", "Nepali", "npi_Deva"),
    ("si", "Sinhala", "sin_Sinh"),
    ("ka", "Georgian", "kat_Geor"),
    ("az", "Azerbaijani", "azj_Latn"),
    ("uz", "Uzbek", "uzn_Latn"),
    ("kk", "Kazakh", "kaz_Cyrl"),
    ("mn", "Mongolian", "khk_Cyrl"),
)
MIN_MEAN_PROBABILITY = 0.35
MAX_TOKEN_SHARE, LEAST_TOKENS = 0.55, 5
MAX_PAIR_SHARE, LEAST_PAIR_TOKENS = 0.45, 6

TOKEN_EDGES = ".,!?;:、，。"
KEY_EDGES = ".,!?;:、，。？！；："
CLINGS = "' ’ , . ! ? : ;".split()
CLINGS_WIDE = tuple(",.!?;:…)»”'’%")


def contains_made_up(text: Column, phrases=MADE_UP_PHRASES) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(" \t\n\r\f\v"))


def bare_token(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(TOKEN_EDGES))


def word_key(word: Column) -> Column:
    """What two hypotheses must agree on."""
    return F.btrim(F.lower(F.trim(word)), F.lit(KEY_EDGES))


def words(text: Column) -> Column:
    """Pieces between white space, without blanks."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _top_share(items: Column) -> Column:
    """The share of the most frequent item of an array: the longest run of the sorted items."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(s, x):
        run = F.when(s["last"].eqNullSafe(x), s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["top"], run).alias("top"))

    return F.aggregate(F.array_sort(items), start, step)["top"] / F.size(items)


def top_token_share(tokens: Column) -> Column:
    return F.when(F.size(tokens) >= LEAST_TOKENS, _top_share(tokens)).otherwise(F.lit(0.0))


def top_pair_share(tokens: Column) -> Column:
    following = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.filter(F.zip_with(tokens, following, lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
    return F.when(F.size(tokens) >= LEAST_PAIR_TOKENS, _top_share(pairs)).otherwise(F.lit(0.0))


def is_hallucination(word_array: Column) -> Column:
    """Verdict on an array of structs with word and probability; none: false.

    Words are joined trimmed, with one space; null and empty ones have a probability but no text.
    """
    n = F.size(word_array)
    mean = F.aggregate(word_array, F.lit(0.0), lambda s, w: s + F.coalesce(w["probability"], F.lit(0.0))) / n
    said = F.filter(word_array, lambda w: w["word"] != "")
    joined = F.array_join(F.transform(said, lambda w: trimmed(w["word"])), " ")
    tokens = F.transform(said, lambda w: bare_token(w["word"]))
    bad = (
        (mean < MIN_MEAN_PROBABILITY)
        | contains_made_up(joined)
        | (top_token_share(tokens) > MAX_TOKEN_SHARE)
        | (top_pair_share(tokens) > MAX_PAIR_SHARE)
    )
    return F.when(n > 0, bad).otherwise(F.lit(False))


def _compose(word_array: Column, clings) -> Column:
    edge = F.array(*[F.lit(c) for c in clings])

    def spaced(w):
        return F.when(F.array_contains(edge, F.substring(w, 1, 1)), w).otherwise(F.concat(F.lit(" "), w))

    return F.array_join(F.transform(F.filter(word_array, lambda w: w != ""), spaced), "")


def compose(word_array: Column) -> Column:
    """Words to a text; marks and words that bring their own space are not spaced, null and empty ones left out."""
    return F.trim(_compose(word_array, (*CLINGS, " ")))


def compose_wide(word_array: Column) -> Column:
    """The same with more marks; words keep the spaces they bring, and only the first stands without one before it."""
    return F.regexp_replace(_compose(word_array, CLINGS_WIDE), "^ ", "")


def sentences(text: Column) -> Column:
    """Runs up to sentence marks, trimmed, without blanks; without any, the whole text."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?。？！]+[.!?。？！]+|[^.!?。？！]+$"), F.lit(0))
    kept = F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")
    # A lambda's variable is worked out once; a plain column would be for each time that it is named.
    return F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(text)))[0]


#: Where a text is split at punctuation.
_AFTER_MARK = re.compile(r"(?<=[.!?;,。！？，；])\s*", re.ASCII)


def pieces_of(text: str, how: str, most_words: int) -> list[tuple[str, int, int]]:
    """(piece, characters before it, characters up to its end) of a text split at punctuation or after so many words."""
    if how == "punctuation":
        parts = [p for p in _AFTER_MARK.split(text) if p.strip(" ")]
    else:
        w = [x for x in re.split(r"\s+", text, flags=re.ASCII) if x]
        parts = [" ".join(w[i : i + most_words]) for i in range(0, max(len(w), 1), most_words)]
    ends = list(accumulate(map(len, parts), initial=0))
    return list(zip(parts, ends, ends[1:]))


def pieces(text: Column, how: str, most_words: int = 6) -> Column:
    """pieces_of as an array; expressions would split a text anew for each of its pieces."""

    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pieces_of(t, how, most_words))

    return F.pandas_udf(split, "array<struct<piece:string,before:bigint,after:bigint>>")(text)


def quoted(query: str) -> str:
    """A pattern for a literal text, any case."""
    return "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", query)


def count_matches(text: Column, query: str) -> Column:
    return F.regexp_count(text, F.lit(quoted(query.strip()))).cast("bigint") if query.strip() else F.lit(0).cast("bigint")


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def replace_all(text: Column, query: str, by: str) -> Column:
    return F.regexp_replace(text, quoted(query.strip()), _literal(by)) if query.strip() else text


def replace_first(text: Column, query: str, by: str) -> Column:
    if not query.strip():
        return text
    return F.regexp_replace(text, "(?s)^(.*?)" + quoted(query.strip()), "$1" + _literal(by))


def highlight(text: Column, query: str) -> Column:
    return F.regexp_replace(text, quoted(query.strip()), "<mark>$0</mark>") if query.strip() else text


def draft_key(text: Column) -> Column:
    """The form under which a draft's translation is used again."""
    return F.lower(F.regexp_replace(F.trim(text), r"[\s.!?。！？,;，；:]+$", ""))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def masked(secret: Column) -> Column:
    """First and last four characters; shorter secrets wholly hidden."""
    shown = F.concat(F.left(secret, F.lit(4)), F.lit("..."), F.right(secret, F.lit(4)))
    return F.when(secret == "", "").when(F.length(secret) < 9, "...").otherwise(shown)


def label_of(pos: Column) -> Column:
    """Speaker A..Z by position from 0, then numbers."""
    return F.when(pos < 26, F.concat(F.lit("Speaker "), F.char(65 + pos))).otherwise(F.concat(F.lit("Speaker "), (pos + 1).cast("string")))


def prompt_line(number: Column, text: Column) -> Column:
    return F.format_string("%d. %s", number, F.when(trimmed(text) == "", "[EMPTY]").otherwise(trimmed(text)))


def parse_numbered(response: Column, n: Column) -> Column:
    """A numbered answer as an array of n texts.

    The last of equal numbers counts, numbers past n are dropped, [EMPTY] is
    empty, missing numbers are empty; without any number the non-blank lines
    count by position.
    """
    pattern = F.lit(r"(?md)^(\d+)\.\s*(.*)$")
    found = F.arrays_zip(
        F.regexp_extract_all(response, pattern, F.lit(1)).alias("number"), F.regexp_extract_all(response, pattern, F.lit(2)).alias("said")
    )
    lines = F.transform(
        F.filter(F.split(response, "\n"), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(F.trim(x), r"^\d+[.)]\s*", "")
    )
    places = F.sequence(F.lit(1), n)

    def numbered(i):
        mine = F.filter(found, lambda x: x["number"].cast("decimal(38,0)") == i)
        return F.coalesce(F.trim(F.get(mine, F.size(mine) - 1)["said"]), F.lit(""))

    picked = F.when(F.size(found) > 0, F.transform(places, numbered)).otherwise(
        F.transform(places, lambda i: F.coalesce(F.get(lines, i - 1), F.lit("")))
    )
    return F.transform(picked, lambda t: F.when(t == "[EMPTY]", "").otherwise(t))


def request_for(source_name: Column, target_name: Column, text: Column, style: str = "chat") -> Column:
    """What to ask a provider, as a struct of a system message (null where the style has none) and a user message.

    chat and roles ask for a batch of numbered lines, line and single for one text.
    """
    both = [F.lit(" from "), source_name, F.lit(" to "), target_name]
    none = F.lit(None).cast("string")
    if style == "chat":
        system, user = none, [F.lit("Translate the numbered lines"), *both, F.lit(". Answer with the same numbers, one line each.\n\n"), text]
    elif style == "roles":
        system = F.concat(F.lit("You translate speech"), *both, F.lit(". Keep its meaning, tone and style, and let it sound like talk."))
        user = [F.lit("Translate the numbered lines. Answer with the same numbers, one line each, and nothing else.\n\n"), text]
    elif style == "line":
        system, user = none, [F.lit("Translate to "), target_name, F.lit(". Answer with the translation only.\nText: "), text, F.lit("\nTranslation:")]
    elif style == "single":
        system = F.concat(F.lit("You are a translator. Translate the text"), *both, F.lit(" and answer with nothing but the translation."))
        user = [text]
    else:
        raise ValueError(style)
    return F.struct(system.alias("system"), F.concat(*user).alias("user"))


def share_of_time(start: Column, end: Column, before: Column, total: Column) -> Column:
    """The time at which a share of a span ends, as a floor of the whole share."""
    return start + div((end - start) * before, F.greatest(total, F.lit(1)))


@F.pandas_udf(ArrayType(StringType()))
def dealt(counts: pd.Series, whole: pd.Series) -> pd.Series:
    """A text's words dealt to pieces by their word counts: half-up shares, at least one, what is left to the last; one piece has the text as it is."""

    def deal(counts, whole):
        if len(counts) == 1 or whole is None:
            return [whole] * len(counts)
        words = [w for w in re.split(r"\s+", whole, flags=re.ASCII) if w]  # one text's words at a time
        total, begin, out = max(1, int(sum(counts))), 0, []
        for n in counts:
            take = max(1, int(np.floor(n / total * len(words) + 0.5)))
            out.append(" ".join(words[begin : begin + take]))
            begin += take
        out[-1] = " ".join(words[begin - take :])
        return out

    return pd.Series([deal(*x) for x in zip(counts, whole)])

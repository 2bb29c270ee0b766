"""Text functions as JVM column expressions. Patterns with \\w, \\s or \\b carry (?U), so that they know all scripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The models' aliases.
ALIASES = {
    "gpt": ["gpt", "chatgpt", "openai"],
    "claude": ["claude", "anthropic"],
    "gemini": ["gemini", "bard"],
    "grok": ["grok", "xai"],
    "llama": ["llama"],
    "deepseek": ["deepseek"],
}
# Words that mark a text as being about AI; the strict ones as whole words, the others as beginnings.
AI_STRICT = "ai agi llm llms rag mcp gpt grok sora xai".split()
AI_LOOSE = [
    "chatgpt", "openai", "anthropic", "claude", "gemini", "bard", "llama", "deepseek",
    "copilot", "cursor", "perplexity", "midjourney", "stable diffusion", "notebooklm",
    "qwen", "ollama", "prompt", "agent", "chatbot", "genai", "generative ai",
    "machine learning", "deep learning", "neural net", "transformer", "fine-tun", "diffusion",
]
AI_ZH = (
    "人工智慧 人工智能 生成式 提示詞 提示工程 大語言模型 大型語言模型 語言模型 大模型 機器學習 深度學習 神經網路 神經網絡 微調 "
    "智能體 智慧體 聊天機器人 對話機器人 文生圖 生成圖片 生圖 向量資料庫 嵌入向量 演算法"
).split()
# Fixed value: characters that only simplified Chinese uses.
SIMPLIFIED = "这个们时软网务实习边龙应经见觉单题类样优关处还发区图说话语让对没来国师业东车书长门问间风马鱼爱万与专写号体术认识记设计编辑视频频导"
_CJK = r"[\x{4e00}-\x{9fff}]"


def alias_pattern(slug: str) -> str:
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({'|'.join(ALIASES[slug])})([^\p{{L}}\p{{N}}_]|$)"


def match_models(text: Column) -> Column:
    """Slugs of the models a text names as whole words, in the order of ALIASES; empty for null."""
    return F.filter(F.array(*[F.when(text.rlike(alias_pattern(s)), s) for s in ALIASES]), lambda x: x.isNotNull())


def is_ai_related(text: Column) -> Column:
    """Whether a text is about AI in the wide sense; false for null."""
    latin = rf"(?i)(?<![a-z])(?:{'|'.join(AI_STRICT)})(?![a-z])|(?<![a-z])(?:{'|'.join(AI_LOOSE)})"
    return F.coalesce(text.rlike(latin) | text.rlike("|".join(AI_ZH)), F.lit(False))


def looks_simplified(text: Column, least: int = 2) -> Column:
    return F.coalesce(F.length(text) - F.length(F.translate(text, SIMPLIFIED, "")) >= least, F.lit(False))


def cjk_ratio(text: Column) -> Column:
    """Share of Chinese characters; 0 for null and empty texts."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(_CJK)) / F.length(text)).otherwise(F.lit(0.0))


def needs_translation(text: Column) -> Column:
    return F.coalesce((F.length(F.trim(text)) >= 3) & (cjk_ratio(text) < 0.15), F.lit(False))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    import html

    return texts.map(lambda t: None if t is None else html.unescape(t))


def unescape_html(text: Column) -> Column:
    """HTML entities as characters; no built-in does this, but only texts with an ampersand travel to Python."""
    return F.coalesce(_unescaped(F.when(text.contains("&"), text)), text)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", " ")


def pangu_spacing(text: Column) -> Column:
    """A blank between Chinese and Latin or digits."""
    return F.regexp_replace(F.regexp_replace(text, rf"({_CJK})([A-Za-z0-9])", "$1 $2"), rf"([A-Za-z0-9])({_CJK})", "$1 $2")


def split_sentences(text: Column) -> Column:
    """Sentences that end in 。！？.!? or at a line break; without blanks around them, at least two characters and one of a word."""
    parts = F.split(text, r"(?<=[。！？.!?])|[\n\r]+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: (F.length(s) >= 2) & s.rlike(r"(?U)\w"))


def split_summary(text: Column) -> Column:
    """Sentences of a summary: decimals and domains stay whole."""
    parts = F.split(text, r"[。！？!?]+|\n+|(?<=[A-Za-z0-9])\.(?:\s+|$)")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def parse_citations(text: Column) -> Column:
    """Numbers of [1], [2][3], [1, 2] in order, each once; empty for null."""
    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]"), F.lit(0))
    numbers = F.flatten(F.transform(marks, lambda m: F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0))))
    return F.array_distinct(F.transform(numbers, lambda n: n.cast("int")))


def strip_citations(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]", ""), r"[ \t]+", " "))


def make_title(text: Column) -> Column:
    """Up to the first sentence end, at most 24 characters."""
    first = F.regexp_extract(F.trim(text), r"^([^。！？!?]*)", 1)
    return F.when(F.length(first) > 24, F.concat(F.substring(first, 1, 24), F.lit("…"))).otherwise(first)


def event_key(ids: Column) -> Column:
    """A key of a set of ids, whatever their order."""
    return F.substring(F.sha1(F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), "␟")), 1, 16)


def normalize_title(title: Column) -> Column:
    """Lower case without a Show/Ask/Tell HN prefix, notes in brackets and punctuation."""
    # The prefix and the notes.
    text = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)^\s*(show|ask|tell)\s+hn[:\-\s]+", "")
    text = F.regexp_replace(text, r"(?U)[\[(]\s*(pdf|video|2\d{3}|19\d{2}|slides?|gist)\s*[\])]", " ")
    return collapse(F.regexp_replace(text, r"(?U)[^\w\s]", " "))


def title_tokens(title: Column) -> Column:
    return F.filter(F.array_distinct(F.split(normalize_title(title), " ")), lambda t: t != "")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 where either set is empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / union).otherwise(F.lit(0.0))


# The parameters that only track, and the prefixes of such.
TRACKING = "fbclid gclid dclid msclkid yclid igshid mc_cid mc_eid ref_src ref_url _hsenc _hsmi vero_id spm scm".split()
TRACKING_PREFIX = "utm_"


def canonical_url(url: Column) -> Column:
    """host/path?query for comparing: no scheme, www., default port, trailing slash, fragment or tracking parameters, query sorted.

    Null for null, blank and other than http(s) addresses, and without a host.
    """
    raw = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    scheme = F.lower(F.regexp_extract(raw, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    full = F.when(scheme == "", F.concat(F.lit("http://"), raw)).otherwise(raw)
    shape = r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    host = F.regexp_replace(F.lower(F.regexp_extract(full, shape, 1)), r"^www\.", "")
    host = F.regexp_replace(host, r":(?:80|443)?$", "")
    path = F.regexp_extract(full, shape, 2)
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))

    def encoded(x: Column) -> Column:
        plain = F.coalesce(F.try_url_decode(x), x)
        return F.replace(F.replace(F.url_encode(plain), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))

    pairs = F.filter(F.split(F.coalesce(F.regexp_extract(full, shape, 3), F.lit("")), "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p: F.struct(encoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), encoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(named, lambda p: ~F.lower(p["k"]).isin(*TRACKING) & ~F.lower(p["k"]).startswith(TRACKING_PREFIX)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    built = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when((raw != "") & scheme.isin("", "http", "https") & (host != ""), built)


# Words that say nothing about a topic.
STOPWORDS = (
    "the a an and or but for to of in on at is are be was were this that with as it you your we our they i my me from by not no so if then than will can just use using "
    "ai model models llm llms use used data new like get make how why what"
).split()


def latin_terms(text: Column) -> Column:
    """The distinct Latin terms of a text: at least two characters with two letters, no stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z0-9]+"), F.lit(0))
    return F.filter(F.array_distinct(words), lambda w: w.rlike("[a-z][0-9]*[a-z]") & ~w.isin(*STOPWORDS))


def cjk_bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring Chinese characters."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{_CJK}{{2,}}"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substring(r, k, F.lit(2))))))


# Traditional characters and the simplified ones they become; of characters with several, the most frequent.
TRADITIONAL = "這個們時軟網務實習邊龍應經見覺單題類樣優關處還發區圖說話語讓對沒來國師業東車書長門問間風馬魚愛萬與專寫號體術認識記設計編輯視頻導過開會學機為動電腦點頭條現產後無當種數據庫練慣難寶護價轉輸圍繼續變論證評測試調節約綠紅紙線組織結構級給絡統總顯項預領額飛飯館驗骯麗麼黃齊齒聽聲職聯聖膽腸臉興舉舊華葉藝蘇蘭蘿虛蟲衛衝補裝製複觀規覽觸訂訊討訓託許訴詞詩該詳誌誤誰課誼談請諸諾謀謝謠譯議讀"
TO_SIMPLIFIED = "这个们时软网务实习边龙应经见觉单题类样优关处还发区图说话语让对没来国师业东车书长门问间风马鱼爱万与专写号体术认识记设计编辑视频导过开会学机为动电脑点头条现产后无当种数据库练惯难宝护价转输围继续变论证评测试调节约绿红纸线组织结构级给络统总显项预领额飞饭馆验肮丽么黄齐齿听声职联圣胆肠脸兴举旧华叶艺苏兰萝虚虫卫冲补装制复观规览触订讯讨训托许诉词诗该详志误谁课谊谈请诸诺谋谢谣译议读"


def to_simplified(text: Column, traditional: str = TRADITIONAL, simplified: str = TO_SIMPLIFIED) -> Column:
    """Traditional characters as simplified ones, character by character. The tables are parameters: a full one may be given."""
    return F.translate(text, traditional, simplified)


def to_traditional(text: Column, traditional: str = TRADITIONAL, simplified: str = TO_SIMPLIFIED) -> Column:
    """The other way round; a simplified character that stands for several becomes the first of them in the table."""
    return F.translate(text, simplified, traditional)


def first_filled(*texts: Column) -> Column:
    """The first text that is neither null nor blank, trimmed; null if there is none."""
    return F.coalesce(*[F.nullif(F.trim(t.cast("string")), F.lit("")) for t in texts])


# The keys of an annotator for each kind of label.
LABEL_KEYS = {
    "sentiment": {"1": "negative", "2": "neutral", "3": "positive"},
    "quality": {"h": "high", "m": "mid", "l": "low"},
    "theme": {"m": "模型動態", "t": "新工具", "u": "使用方法", "r": "風險限制", "e": "倫理法規", "o": "其他"},
}


def label_of_key(key: Column, kind: str) -> Column:
    """The label of a pressed key, whatever its case; null for another key."""
    pairs = [F.lit(x) for pair in LABEL_KEYS[kind].items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(key)))


def percent(part: Column, whole: Column) -> Column:
    """A share as text with one decimal; 0.0% of nothing."""
    return F.concat(F.format_number(F.coalesce(100 * part / F.nullif(whole, F.lit(0)), F.lit(0.0)), 1), F.lit("%"))


def bar(share: Column, width: int = 20) -> Column:
    """A share as a bar of blocks, filled up with dots."""
    n = F.bround(share * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("·"), F.lit(width) - n))

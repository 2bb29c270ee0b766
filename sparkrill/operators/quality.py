"""Rule-based quality scores: a set of flags for each post and the score left after their deductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrill.functions.text import ALIASES, strip_tags, unescape_html

# Deductions of the flags; SARCASM_DETECTED and the duplicate flags take nothing.
DEDUCTIONS = {
    "TOO_SHORT": 50,
    "LINK_HEAVY": 40,
    "EMOJI_SPAM": 30,
    "ALL_CAPS": 15,
    "EXCESSIVE_PUNCT": 15,
    "SPAM_PHRASE": 50,
    "AD": 30,
    "SEO": 40,
    "AFFILIATE": 40,
    "CLICKBAIT": 30,
    "JOB_POSTING": 50,
    "LIKELY_BOT": 60,
    "KEYWORD_NOT_IN_BODY": 30,
    "OFF_TOPIC": 75,
    "WEAK_KEYWORD": 10,
}
# The patterns of the flags.
URL = r"(?i)https?://\S+|www\.\S+"
EMOJI = r"[\x{1f300}-\x{1faff}\x{2600}-\x{27bf}\x{1f000}-\x{1f0ff}\x{2b00}-\x{2bff}]"
PROMO = r"(?iU)\b(subscribe\s+now|buy\s+now|order\s+now|shop\s+now|limited\s+time|act\s+now|don'?t\s+miss|discount|coupon|promo\s*code|voucher|cashback|\d{1,3}\s?%\s?off|save\s+\d{1,3}\s?%|free\s+trial|best\s+price|lowest\s+price|money[-\s]?back|guarantee[d]?)\b"
CTA = r"(?iU)\b(click\s+here|link\s+in\s+bio|dm\s+me|check\s+out\s+my|visit\s+(our|my))\b"
AFFILIATE = r"(?iU)[?&](ref|aff|affiliate|utm_[a-z]+|tag)=|/aff/|\b(bit\.ly|tinyurl|lnkd\.in|t\.co)\b"
JOB = r"(?iU)\b(we'?re\s+hiring|now\s+hiring|apply\s+now|job\s+(opening|posting)|open\s+(role|position)|remote\s+(role|position)|send\s+your\s+resume|\$\d{2,3}k(/yr|/year)?)\b"
CLICKBAIT = r"(?iU)(you\s+won'?t\s+believe|this\s+one\s+(trick|weird)|will\s+(shock|blow\s+your\s+mind)|what\s+happens\s+next|(doctors|experts)\s+hate|\bthe\s+truth\s+about\b)"
SEO_LIST = r"(?iU)\b(best|top)\s+\d+\b.*\b20\d\d\b"
BOT = r"(?i)(bot[_-]?\d*$|^auto[_-]|[_-]bot$|^ai[_-]?\d+$|[_-]gpt[_-]?\d*$)"
SARCASM = r"(?iU)(/s\b|\boh\s+great\s+another\b|\bwow,?\s+just\s+wow\b|\bwhat\s+a\s+surprise\b)"
DISCUSSION = r"(?iU)\b(review|benchmark|bench|vs|versus|compare|comparison|use[ds]?|using|try|tried|api|prompt|prompting|context|token|fine[-\s]?tune|finetune|rag|agent|release[d]?|launch|update|version|performance|latency|cost|pricing|hallucinat|reasoning|coding|capab|quality|accuracy|fail|broke|slow|fast|better|worse)\b"
AI_CONTEXT = r"(?iU)\b(ai|llm|llms|ml|model|models|chatbot|assistant|neural|transformer|inference|weights|quantiz\w*|gguf|ollama|vllm|gpu|vram|local|opensource|open[-\s]?source|hugging\s?face|generat\w*|copilot|agent|coding|developer|prompt|token|cpp|fine[-\s]?tune|opus|sonnet|haiku|flash|benchmark|\d{1,3}b|gpt|chatgpt|openai|claude|anthropic|bard|xai|deepseek|google|meta|deepmind|microsoft|mistral|qwen)\b"
AI_CONTEXT_ZH = "生成|提示詞|提示|模型|訓練|微調|部署|推理|開源|智能體|智慧體|代理|工具|外掛|擴充|對話|提問|寫程式|編程|程式碼|代碼|向量|語料|多模態"
AS_PRODUCT = r"(?iU)\b(llama|gemini|grok)[\s.\-]?(\d|cpp|flash|pro|omni|max|mini|nano|ultra|vision|code[rd]?|guard|scout|next|thinking)"
OFF_TOPIC = r"(?iU)(♈|♉|♊|♋|♌|♍|♎|♏|♐|♑|♒|♓|🦙|🐄|🫏|\b(aries|taurus|libra|scorpio|sagittarius|capricorn|aquarius|pisces|zodiac|horoscope|tarot|astrolog\w*|air\s+signs?)\b|星座|占星|塔羅|生肖|上升星|月亮星|水瓶座|天秤座|射手座|金牛座|雙子座|巨蟹座|獅子座|天蠍座|摩羯座|雙魚座|hermoso|machito)"
AMBIGUOUS = ("gemini", "grok", "llama")
TECH_SOURCES = ("hackernews", "devto", "lobsters")
STUFFING_STOPWORDS = "the a an and or but for to of in on at is are be was were this that with as it you your we our they i my me he she his her them from by not no so if then than".split()
MIN_SUBSTANCE, MAX_LINKS, MAX_EMOJI, MAX_CAPS, STUFF_REPEAT, STUFF_SHARE = 20, 0.6, 8, 0.6, 5, 0.08


def _length_of(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x))


def _stuffed(raw: Column, models: Column) -> Column:
    """One word repeats often and fills much of the text: longest run in the sorted words. Aliases of the post's models don't count."""
    every = [a for names in ALIASES.values() for a in names]

    def own_alias(w: Column) -> Column:
        found = F.lit(False)
        for slug, names in ALIASES.items():
            found = found | (w.isin(*names) & F.array_contains(models, slug))
        return w.isin(*every) & found

    words = F.array_sort(F.filter(F.regexp_extract_all(F.lower(raw), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(*STUFFING_STOPWORDS) & ~own_alias(w)))
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, word: Column) -> Column:
        run = F.when(state["word"] == word, state["run"] + 1).otherwise(F.lit(1))
        return F.struct(word.alias("word"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    best = F.aggregate(words, start, step, lambda s: s["best"])
    return (best >= STUFF_REPEAT) & (best / F.size(words) > STUFF_SHARE)


def scored(posts: DataFrame) -> DataFrame:
    """posts (title, content, author, source, models) with quality_score and the sorted quality_flags.

    Null texts count as empty, null models as none. A deleted post has score 0 and only that flag.
    """
    models = F.coalesce(F.col("models"), F.array().cast("array<string>"))
    rows = posts.withColumn("_title", unescape_html(F.trim(F.coalesce("title", F.lit(""))))).withColumn("_content", strip_tags(unescape_html(F.coalesce("content", F.lit("")))))
    title, content = F.col("_title"), F.col("_content")
    rows = rows.withColumn("_raw", F.concat(title, F.lit("\n"), content))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(content, r"(?s)```.*?```|`[^`]+`", " "), r"\[[^\]]*\]\([^)]*\)", " "), URL, " ")
    rows = rows.withColumn("_body", body)
    rows = rows.withColumn("_visible", F.concat(title, F.lit("\n"), F.col("_body")))
    raw, visible = F.col("_raw"), F.col("_visible")
    substance = F.regexp_replace(F.regexp_replace(visible, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    # Each costly pattern runs once a row.
    rows = rows.withColumn("_words", F.regexp_extract_all(raw, F.lit("[A-Za-z]{3,}"), F.lit(0))).withColumn("_promo", F.regexp_count(raw, F.lit(PROMO)))
    words, promo = F.col("_words"), F.col("_promo")
    caps = F.size(F.filter(words, lambda w: w == F.upper(w)))
    deleted = title.rlike(r"(?i)^\s*\[(deleted|removed)\]\s*$") | content.rlike(r"(?i)^\s*\[(deleted|removed)\]\s*$")
    known = {slug: F.array_contains(models, slug) for slug in ALIASES}

    def mention(slug: str) -> str:
        return rf"(?iU)\b(?:{'|'.join(ALIASES[slug])})\b"

    in_title = F.lit(False)
    for slug, named in known.items():
        in_title = in_title | (named & title.rlike(mention(slug)))
    hits = F.greatest(*[F.when(named, F.regexp_count(visible, F.lit(mention(slug)))).otherwise(0) for slug, named in known.items()])
    rows = rows.withColumn("_in_title", in_title).withColumn("_hits", hits)
    in_title, hits = F.col("_in_title"), F.col("_hits")
    some = F.size(models) > 0
    hidden = some & (hits == 0)
    unclear = F.forall(models, lambda m: m.isin(*AMBIGUOUS)) & ~F.lower(F.coalesce("source", F.lit(""))).isin(*TECH_SOURCES)
    context = visible.rlike(DISCUSSION) | visible.rlike(AI_CONTEXT) | visible.rlike(AI_CONTEXT_ZH) | visible.rlike(AS_PRODUCT)
    off_topic = some & ~hidden & unclear & visible.rlike(OFF_TOPIC) & ~context
    conditions = {
        "TOO_SHORT": F.length(substance) < MIN_SUBSTANCE,
        "LINK_HEAVY": _length_of(F.regexp_extract_all(content, F.lit(URL), F.lit(0))) > MAX_LINKS * F.length(content),
        "EMOJI_SPAM": F.regexp_count(raw, F.lit(EMOJI)) > MAX_EMOJI,
        "ALL_CAPS": (F.size(words) >= 4) & (caps / F.size(words) > MAX_CAPS),
        "EXCESSIVE_PUNCT": raw.rlike(r"[!?]{3,}|!{5,}"),
        "SPAM_PHRASE": promo >= 2,
        "AD": (promo >= 1) & raw.rlike(CTA),
        "SEO": _stuffed(raw, models) | (F.regexp_count(raw, F.lit(r"(?U)(?<![\w&])#\w+")) >= 3) | title.rlike(SEO_LIST),
        "AFFILIATE": raw.rlike(AFFILIATE) & (promo >= 1),
        "CLICKBAIT": title.rlike(CLICKBAIT),
        "JOB_POSTING": raw.rlike(JOB),
        "LIKELY_BOT": F.coalesce(F.col("author").rlike(BOT), F.lit(False)),
        "KEYWORD_NOT_IN_BODY": hidden,
        "OFF_TOPIC": off_topic,
        "WEAK_KEYWORD": some & ~hidden & ~off_topic & (hits <= 1) & ~in_title,
        "SARCASM_DETECTED": raw.rlike(SARCASM),
    }
    found = F.array_sort(F.filter(F.array(*[F.when(c, name) for name, c in conditions.items()]), lambda f: f.isNotNull()))
    rows = rows.withColumn("quality_flags", F.when(deleted, F.array(F.lit("DELETED"))).otherwise(found))
    off = sum((F.when(F.array_contains("quality_flags", name), F.lit(points)).otherwise(F.lit(0)) for name, points in DEDUCTIONS.items()), F.lit(0))
    score = F.when(F.array_contains("quality_flags", "DELETED"), 0).otherwise(F.greatest(F.lit(0), 100 - off))
    return rows.withColumn("quality_score", score.cast("int")).drop("_title", "_content", "_raw", "_body", "_visible", "_words", "_promo", "_in_title", "_hits")

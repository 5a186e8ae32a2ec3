"""Word lists, patterns, thresholds and labels the results depend on."""

# --- fixed values: correction dictionary ------------------------------------
BASE_CORRECTIONS = [
    ("剪報", "簡報"),
    ("因該", "應該"),
    ("在來", "再來"),
]

# --- fixed values: prefixes that mark a segment as invented -------------------
DROP_PREFIXES = [
    "內容包含：",
    "這是一段關於技術開發",
    "这是一段繁体中文",
    "请注意",
    "Please note",
    "Thank you",
    "thanks for",
    "Subtitles",
    "Subscribe",
    "sub",
    "字幕由",
    "字幕君",
    "主題曲",
    "主題人說",
    "全片以",
    "waar",
]
# --- fixed values: prefixes wrapped around real speech ------------------------
STRIP_PREFIXES = [
    "主題是,",
    "主題是",
    "主題,",
    "主題曲是",
    "主題員,",
    "主題員",
    "領域內容包含",
]
STRIP_AFTER_PREFIX = " ,,。."

# --- fixed values: garbled text ------------------------------------------------
WIDE_CLASS = "[一-鿿㐀-䶿豈-﫿　-〿＀-￯，。！?、;:「」『』(()《》〈〉—…·~]"
NOISE_GLYPH_CLASS = "[┌┐└┘├┤┬┴┼│─⊇◡◬Ⓓ჏ს⓪①②③④⑤⑥⑦⑧⑨]"
EXOTIC_CLASS = "[Ⴀ-ჿ؀-ۿЀ-ӿ฀-๿ऀ-ॿ]"
LONG_LATIN = r"(?:[a-zA-Z]{2,}\s+){5,}"
LATIN_CLASS = "[A-Za-zÀ-ɏ]"
WIDE_RATIO_MIN = 0.25
MIN_CHARS_FOR_RATIO = 10
NOISE_GLYPH_MAX = 1
LONG_LATIN_WIDE_MAX = 0.5
REPLACEMENT_CHAR = "\ufffd"

IDEOGRAPH_CLASS = "[一-鿿]"
IDEOGRAPH_EXT_CLASS = "[一-鿿㐀-䶿]"
#: Ideographs, their punctuation and full-width forms.
WIDE_CONTEXT_CLASS = "[一-鿿㐀-䶿豈-﫿　-〿＀-￯]"

# --- fixed values: invented segments by language ---------------------------------
ENGLISH_HALLUCINATIONS = [
    r"^subtitles by\b",
    r"\bamara\.org\b",
    r"^thank you for watching\b",
    r"^thanks for watching\b",
    r"^please subscribe\b",
    r"^subscribe\b",
    r"^the end\.?$",
    r"^\.+$",
    r"^[\s.\-—]*$",
    r"^\(.*(music|applause|laughter).*\)$",
    r"^\[.*(music|applause|laughter).*\]$",
    r"^featuringasm ei gummy$",
    r"^key terms\b",
    r"^end of transcript\b",
    r"^end credits\b",
    r"\btranscription by\b",
    r"\btranslation by\b",
    r"\bcastingwords\b",
    r"\bcc by\b",
    r"^captions? by\b",
    r"\bESO[ ,.]",
]
NON_LATIN_CLASS = "[Ѐ-ӿ぀-ヿ一-鿿가-힯؀-ۿ]"
LATIN_RATIO_MIN = 0.5
LATIN_RATIO_CHARS = 8
ITALIAN_HALLUCINATIONS = [
    r"^\.{2,}$",
    r"^Grazie\s*$",
    r"^Grazie a tutti\s*$",
    r"^Grazie per la visione\s*$",
    r"^Grazie mille\s*$",
    r"la citt[àa] di San Paolo",
    r"la citt[àa] di San Marco.*Dante",
    r"la citt[àa] di San Francesco",
    r"la citt[àa] di San Lorenzo",
    r"^Sottotitoli\s",
    r"^Subscribe",
    r"^Thank you",
    r"^Please note",
]
MARKER_EMOJI = r"[✅✸✦⏩○≅⏭]+\s*"
NOTES_PUNCTUATION = r"^[。,、.,\s·…\-—~!?！?]*$"
NOTES_JUNK = r"^(ke+y?\s+terms?\b|kee terms\b|br\.\.|※|請訂閱|字幕)"
NOTES_HALLUCINATIONS = (
    r"^(thank(s| you) for watching|please subscribe|subscribe\b|the end\.?$|"
    r"end of transcript|end credits|subtitles by|captions? by|transcription by)"
)
FOREIGN_SCRIPT_CLASS = "[가-힣Ѐ-ӿ฀-๿]"
SEAM_START = r"^[。\.\s…—·,，、]+"
SEAM_START_DASH = r"^[…—\-]+"
SEAM_TRAILING_CAPS = r"\s*(?:[A-Z]{2,}[\s,]+){1,}[A-Z]{2,}\s*$"
SEAM_NAMES = [("Klaude", "Claude"), ("klaude", "Claude")]

# --- fixed values: repeat loops -----------------------------------------------------
RUN_MIN = 4
FEW_CHARS_LEN = 6
FEW_CHARS_MAX = 2
PHRASE_LENGTHS = (2, 3, 4, 5, 6)
PHRASE_REPEATS = 4
ARTIFACT_TEXT = {
    "replacement": "含 U+FFFD 解碼失敗字元",
    "run": "同字元連續重複 {n} 次",
    "few": "整句僅由 {k} 種字元組成({n} 字)",
    "phrase": "短語「{gram}」連續重複 {n} 次",
    "mark": "⚠ASR-artifact：",
}

# --- fixed values: punctuation widths -------------------------------------------------
HALF_TO_FULL = [
    (",", "，"),
    (".", "。"),
    ("?", "？"),
    ("!", "！"),
    (":", "："),
    (";", "；"),
    ("(", "（"),
    (")", "）"),
]
ELLIPSIS = "……"

# --- fixed values: document pages -------------------------------------------------------
GARBLE_CHARS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{E000}-\\x{F8FF}\\x{FFFD}]"
PAGE_NOISE = [
    r"^\d{1,4}$",
    r"^[-–—]\s*\d{1,4}\s*[-–—]$",
    r"^第\s*\d{1,4}\s*頁(?:\s*/\s*\d+)?$",
    r"^[Pp]age\s+\d+(\s+of\s+\d+)?$",
]
DECORATIVE_LINE = r"^[─━—–\-=~·•◆▪□■○●※★☆†‡§¶∙‧]+$"
SECTION_PATTERNS = [
    (r"^第\s*([零一二三四五六七八九十百千\d]+)\s*章\s*(.{0,60})", "chapter"),
    (r"^第\s*([零一二三四五六七八九十百千\d]+)\s*部\s*(.{0,60})", "part"),
    (r"^第\s*([零一二三四五六七八九十百千\d]+)\s*[節节]\s*(.{0,60})", "section"),
    (r"^第\s*([零一二三四五六七八九十百千\d]+)\s*[講讲]\s*(.{0,60})", "lecture"),
    (r"^第\s*([零一二三四五六七八九十百千\d]+)\s*[課课]\s*(.{0,60})", "lesson"),
    (r"^第\s*([零一二三四五六七八九十百千\d]+)\s*單元\s*(.{0,60})", "unit"),
    (r"^第\s*([零一二三四五六七八九十百千\d]+)\s*单元\s*(.{0,60})", "unit"),
    (r"^Chapter\s+(\d+|[IVXLCDM]+)[:\.\s]\s*(.{0,60})", "chapter"),
    (r"^Part\s+(\d+|[IVXLCDM]+)[:\.\s]\s*(.{0,60})", "part"),
    (r"^Section\s+(\d+\.?\d*)[:\.\s]\s*(.{0,60})", "section"),
    (r"^Lecture\s+(\d+)[:\.\s]\s*(.{0,60})", "lecture"),
    (r"^Lesson\s+(\d+)[:\.\s]\s*(.{0,60})", "lesson"),
    (r"^Module\s+(\d+)[:\.\s]\s*(.{0,60})", "module"),
]
SUBSECTION_LEVELS = ["section"]
AGENDA_HEADING = "## 議程"
TALK_LINES = ["**講者:**", "**講題:**"]

# --- fixed values: text seen on screens ----------------------------------------------------
SCREEN_SUBSTRINGS = [
    "generative ai",
    "生成式 ai 年會小聚",
    "google translate",
    "q 搜尋",
    "進入全螢幕",
    "进入全屏",
    "分享",
]
SCREEN_PATTERNS = [
    r"^[\d\s:/,.+×xX%°C\-①-⑩④]+$",
    r"^(上午|下午)\s?\d|\d+°C",
    r"多雲|多雰|時陰|時晴|降雨機率",
    r"^第?\s?\d+\s?[页頁]$|^\d+\s?/\s?\d+$",
    r"[a-z0-9.-]+\.(com|ai|io|net|org)/\S{6,}",
]
SCREEN_CROP = {"ratio": 0.35, "x": (0.18, 0.78), "y": (0.12, 0.9)}

# --- fixed values: markup ------------------------------------------------------------------
MARKUP_REASONS = {"unpaired": "~~ 未成對", "unmarked": "無標記", "altered": "改字"}
PHRASE_PUNCTUATION = "。?!…,、;:"
SENTENCE_END = "[.!?。][\"'”’)]?\\s*$"
PARAGRAPH_END = "。!?！…」』）.\""
TRANSLATION_END = "。！？”」』）.!?"
PARAGRAPH_JOINER = "^[，。？！、,.?!]"
NOTE_FIELDS = ["text_in_image", "layout", "speaker_view", "audience_view", "caption"]

# --- fixed values: matching ------------------------------------------------------------------
LATIN_TERM = "[A-Za-z][A-Za-z0-9.+-]{1,}"
NUMBER_TERM = r"\d{2,}"
IDEOGRAPH_RUN = "[一-鿿㐀-䶿]+"
RELEVANCE_FAIL = 0.02
RELEVANCE_HEALTHY = 0.09
MAX_PER_ANCHOR = 2

# --- fixed values: excitement ------------------------------------------------------------------
EXCITEMENT_WEIGHTS = {"rms_db": 0.35, "f0_p75": 0.35, "f0_range": 0.10, "rate": 0.20}

# --- fixed values: attribution -----------------------------------------------------------------
CROSSTALK_FALLBACK_DB = -12.0
FLOOR_BYPASS_LEAD_DB = 10.0
UNCERTAIN_TEXT = {
    "floor_gated": "歸屬不確定（三軌皆近底噪，領先不足）",
    "below_margin": "歸屬不確定（三軌差距 <3dB）",
    "unstable": "歸屬不確定（領先未能持續）",
    "uncut": "換手點附近 250ms 內沒有字界，未切開",
}
REASON_SEPARATOR = "；"
CHANGE_LABELS = {"cut": "剪掉", "restored": "改回保留", "added": "新增"}

# --- fixed values: publishing --------------------------------------------------------------------
RED_FLAGS = ["預告階段", "各上線一本", "即將推出", "首本逐字稿", "尚未上線且", "還沒上線"]
PLACEHOLDER_MARKS = ["placeholder", "佔個位置"]
META_CORE = ["og:title", "og:url", "twitter:card"]
META_IMAGE = ["og:image", "twitter:image"]
BOOK_TEXT_FIELDS = ["id", "title", "subtitle", "date", "venue", "duration", "url"]
BOOK_COUNT_FIELDS = ["words", "height", "width"]

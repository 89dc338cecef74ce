"""Fixed values.

Everything in the first block must equal the original term-mining pipeline's
values for results to match; it is stated here once, in natural order, and
every operator takes it as an overridable default parameter.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original pipeline's)
# ---------------------------------------------------------------------------

# n-gram generation
MAX_GRAM_LEN = 4
GRAM_JOINER = ","
BOUNDARY = "$"

# segment cut: tokens whose part-of-speech starts with one of these
CUT_POS_PREFIXES = ["w", "c", "u", "p", "r"]

# script test: UTF-16 unit in [19968, 171941] and not U+E40C; a Java char is
# at most 65535 so the range is U+4E00..U+FFFF, and a supplementary character
# passes because both of its surrogate halves lie in the range.
SCRIPT_CLASS_CJK = r"\x{4E00}-\x{E40B}\x{E40D}-\x{FFFF}\x{10000}-\x{10FFFF}"

# emoji / private-use ranges replaced by replace_emoji
EMOJI_CLASS = r"\x{1F000}-\x{1F3FF}\x{1F400}-\x{1F7FF}\x{2600}-\x{27FF}\x{E000}-\x{F8FF}"

# stop characters masked before the char miner and the KWIC grep
STOP_CHARS = "的很了么呢是嘛个都也比还这于不与才上用就好在和对挺去后没说"

# cohesion (entropy) job
COHESION_MIN_FREQ = 5
COHESION_MIN_ENTROPY = 1.5

# PMI job
PMI_MIN = 1.0
PMI_SINGLE_SLOPE = 0.8
PMI_SINGLE_INTERCEPT = 0.5
PMI_SINGLE_CONST_MISSING_ZERO = 5.0
PMI_SINGLE_CONST_TRIE = 10.0

# corpus diff
DIFF_MIN_FREQ = 5
DIFF_MIN_ENTROPY = 2.0
DIFF_MIN_PMI = 1.5
RISE_FACTOR = 10
TOP_FRACTION_DIVISOR = 50
PROTECTED_SUBSTRING = "电"

# length factor 1 / exp(|len - 4.5| * 0.3)
LENGTH_CENTER = 4.5
LENGTH_DECAY = 0.3

# final list
FINAL_MIN_PRED = 0.3
FINAL_MIN_PMI = 2.0
FINAL_MIN_FREQ = 20
EVAL_TOP_N = 10000
SINGLE_TOKEN_DROP_POS = ["nr", "v"]
FIRST_POS_DROP = ["p"]
LAST_POS_DROP = ["f"]
ANY_POS_DROP = ["c", "u", "p", "r"]
VERB_POS = "v"

# affix / infix rules of the final list
NO_BEGIN = ["和", "变量", "机理"]
NO_END = ["和", "所示", "变量", "时", "随", "前", "后", "可", "参考", "参考值"]
NO_IN = ["的", "函数", "次数", "误差", "参数", "处于", "计算", "使", "接口", "各",
         "统计", "网格", "温度", "方案", "对数", "配置"]

# threshold report
REPORT_THRESHOLD = 0.8
REPORT_TOP_N = 10000
RANK_BOOST = 0.8

# noun rescue
RESCUE_POS_PREFIX = "n"
RESCUE_POS_EXACT = "vn"
RESCUE_MIN_SCORE = -10000.0

# char-mode miner
CHAR_MIN_PMI = 1.0
CHAR_MIN_ENTROPY = 1.5
CHAR_MIN_POS_PROB = 0.04

# feature averages divide by (n + 1e-8)
AVG_EPS = 1e-8

# keyword-field parsing
KEYWORD_LABELS = ["关键词:", "关键词：", "关键词　"]
KEYWORD_END_MARKERS = ["Keywords", "keywords", "Keywods", "中图分类号", "绪言", "引言", "引 言",
                       "引　言", "概况", "概述", "概　述", "前言", "前　言"]
KEYWORD_TRAILING_DROP = [";", "；"]
KEYWORD_SPLIT_CHARS = ["　", ":", "，", ",", "、", "："]
KEYWORD_TAIL_DROP = ["1", "0", "。"]
KEYWORD_PAREN = ["（", "("]
KEYWORD_REMOVE = "KeyWords"
KEYWORD_EXCLUDE = ["关键词", "\uF0B1", "\uF020"]
KEYWORD_MAX_LEN = 12

# tagged-corpus extraction
CONTENT_OPEN = "<content>"
CONTENT_CLOSE = "</content>"

# special characters stripped from dictionary keys
SPECIAL_KEY_CHARS = r"[\[|*]"

# tail-field concat starts at the 7th comma-separated field
TAIL_FIELD_START = 7

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

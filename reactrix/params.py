"""Weights, thresholds, curves and word lists.

Everything below is a fixed value of the scoring model: changing one changes results.
Rules take these as parameters, so another corpus can pass its own lists.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: score weights and tier lines -----------------------------
W_FAV, W_COIN, W_LIKE = 3.0, 2.0, 0.3
MIN_VIEW = 3000
ABSOLUTE_TIERS = (("high", 0.107), ("normal", 0.064), ("low", 0.042))
RELATIVE_TIERS = (("high", 3.0), ("good", 2.0), ("normal", 1.0), ("low", 0.5))
PORTRAIT_RATIO = 0.9
BAND_WIDTH = 0.2
NEIGHBOUR_WIDTH = 0.25

# ---- fixed values: baseline curve, log10(view) 4.5 .. 7.2 step 0.1 -----------
BASELINE_START, BASELINE_STEP = 4.5, 0.1
BASELINE = (
    0.2065, 0.1745, 0.1376, 0.1247, 0.1154, 0.1057, 0.0919, 0.083, 0.0742, 0.0687,
    0.0605, 0.0577, 0.0557, 0.058, 0.0616, 0.0664, 0.0706, 0.0779, 0.082, 0.0839,
    0.0848, 0.0861, 0.0861, 0.0861, 0.0852, 0.0849, 0.0854, 0.0863,
)

# ---- fixed values: word lists and patterns -----------------------------------
SYMPATHY_STRONG = ("求助", "众筹", "水滴筹", "救救", "化疗", "白血病", "病危", "尿毒症", "渐冻", "重症", "病重", "卖惨", "绝症")
SYMPATHY_WEAK = (
    "感谢", "感恩", "感动", "泪目", "妈妈", "爸爸", "奶奶", "爷爷", "外婆", "外公",
    "生病", "手术", "续命", "苦难", "艰难", "负债", "落魄", "流浪", "抗体", "药",
)
MOTIVE_CUES = (
    "感谢硬币", "硬币之力", "买药", "众筹", "求助", "感动", "泪目", "哭了",
    "耗时", "历时", "历经", "肝了", "爆肝", "熬夜", "花了三年", "花了一年", "坚持了",
    "捐款", "脑瘫", "救助", "白血病", "骨癌", "生活不能自理", "希望以后你的生活", "重建新家",
)
TITLE_REVIEW_WORDS = ("黑丝", "白丝", "纯欲", "擦边", "性感", "热舞", "福利姬")
BLOCK_PATTERNS = ("第[0-9一二三四五六七八九十百]+[集话]", r"挑战[^，。！？\s]{1,12}(？|\?|成功的可能性|能成吗)")
ZONE_WHITELIST = ("电影", "电视剧", "纪录片")
BEGGING_PATTERNS = ("投币.{0,6}更新", "三连.{0,6}更新", "点赞过.{0,6}更新")
HANDMADE_PATTERN = "手搓|自制|耗时|历时|一个人|独自|个月|年半|三年|两年|爆肝|熬夜做完"
SERIES_PATTERN = r"第\s*[0-9一二三四五六七八九十百零〇]+\s*[集话期季回夜章节]|合集|全集|连载|更新至"
NOT_WORK_PATTERN = "直播|回放|录播|解说|集锦|盘点|锐评|课程|公开课|讲座|教程|教学|复盘|赛事|新闻|采访"
FORM_PATTERNS = (
    ("手书", "手书|描改"), ("定格", "定格|逐帧"),
    ("原创曲", "原创曲|原创音乐|VOCALOID|vocaloid|初音|洛天依|诗岸|重音|言和|乐正"),
    ("短片", "短片|微电影|剧情片"), ("动画", "动画|CG|3D|渲染"), ("MV", r"\bMV\b|PV"),
    ("演奏", "演奏|钢琴|吉他|小提琴|二胡|古筝|贝斯"), ("手作", "手作|模型|黏土|木工|手工|改造"),
)
FORM_OTHER = "其他"
ORDINAL = "[0-9零〇一二两三四五六七八九十百千万]+"
EPISODE_PATTERN = (
    rf"第\s*{ORDINAL}\s*[集话話章回期季部]"
    rf"|(?:更新至|连载至|更新到)\s*(?:第\s*)?{ORDINAL}"
    r"|(?<![a-z0-9])s\s*\d+\s*e\s*\d+(?!\d)"
    r"|(?:连续剧|短剧|漫剧|动态漫画|有声小说).{0,16}\d+\s*[集话話]"
)
NUMBER_UNITS = (
    "周年|年|月|日|天|小时|分钟|秒|帧|岁|元|万|亿|期货|人|抽|册|块|刀|攻速|公里|千米|米|℃|%"
    r"|fps\b|hz\b|khz\b|kb\b|mb\b|gb\b|p\b|k\b|×|x\s*\d"
)
TASTE_STOP_TERMS = "4k|60fps|60帧|高清|修复|完整版|神级|神作|经典|无损|教程|中字|官方|视频"
APPROVAL_NEGATIVES = (
    "不神", "不可能神", "不可能是神", "不是神", "不算神", "不值得神", "不够神", "不及神", "但不神", "惩罚",
    "不评价", "不好评价", "存疑", "有待", "门槛", "边边", "感谢类", "肝", "辛苦", "感动", "卖惨", "鼓励",
)
TOP_VERDICT_WORD = "神作"
VERDICT_WORDS = {
    "reject": ("低创", "垃圾", "狗屎", "擦边", "恶心", "自慰", "引流"),
    "top_negated": ("不可能神作", "神作还有待考虑", "够不到神作", "神作还有待考虑，这种不典型", "门槛要更高", "不可能是神作", "很难神"),
    "top": ("神作",),
    "utility": ("吃灰", "教学", "教程", "实用", "跟练"),
    "fine": ("优秀", "值得", "高质", "精良"),
}
REVIEW_REASONS = ("craft_expression", "sentiment_only", "effort_only", "utility_only", "other")
PUBLIC_FIELDS = (
    "item_id", "title", "owner_id", "view", "coin", "fav", "like_cnt", "duration",
    "pub_day", "first_seen", "category", "pct", "ref_n", "screen_flags", "motive_cues",
)
PAGE_ROWS = 96
PICK_ROWS = 600  # length of the daily picks stream
CHAIN_SEEDS = 20  # most viewed seeds of each chain
MAIN_USERS = 20  # strongest users, and probes from the rest
PROBES = 7
WEIGHT_SUBSETS = (  # name, favourite, coin, like
    ("L", 0.0, 0.0, 1.0), ("C", 0.0, 1.0, 0.0), ("F", 1.0, 0.0, 0.0), ("LC", 0.0, 1.0, 1.0),
    ("FC", 1.0, 1.0, 0.0), ("LFC", 1.0, 1.0, 1.0), ("BASE", 3.0, 2.0, 0.3),
)
NAMED_FORMULAS = (  # name, favourite, coin, like, denominator
    ("F1", 0.0, 0.0, 1.0, "view"), ("F2", 0.0, 1.0, 0.0, "view"), ("F3", 1.0, 0.0, 0.0, "view"),
    ("F4", 0.0, 1.0, 1.0, "view"), ("F5", 1.0, 1.0, 0.0, "view"), ("F6", 1.0, 1.0, 1.0, "view"),
    ("F7", 3.0, 2.0, 0.3, "view"), ("F8", 3.0, 2.0, 0.3, "sqrt"), ("F9", 3.0, 2.0, 0.3, "log"),
    ("F10", 0.5, 3.0, 0.1, "view"),
)
DENOMINATORS = ("view", "sqrt", "log")


@dataclass(frozen=True)
class TierRules:
    """One row of the percentile decision table; rule changes are new rows, not new code."""

    top: float = 0.93
    fine: float = 0.85
    plain: float = 0.72
    short_cap: int = 30
    duration_cut: int = 150
    duration_cut_inclusive: bool = True
    hoard_ratio: float = 8.0
    hoard_fav: float = 0.15
    coin_floor_infinite: bool = False  # draft table: no coins means an infinite ratio
    edge_like: float = 0.20
    edge_coin: float = 0.02
    edge_fav: float = 0.10
    edge_cuts: bool = False
    missing_is_plain: bool = False
    support: bool = True
    support_guard: float = 0.50
    strong: tuple = SYMPATHY_STRONG
    weak: tuple = SYMPATHY_WEAK


DRAFT_RULES = TierRules(
    duration_cut=90, duration_cut_inclusive=False, coin_floor_infinite=True, edge_cuts=True,
    missing_is_plain=True, support=False, strong=(), weak=(),
)


@dataclass(frozen=True)
class FeedRules:
    """Feed cascade: title patterns, whitelist and client options."""

    short_max: int = 75
    min_views: int = 1000
    index_min_view: int = 50_000
    index_floor: float = 0.5
    block: tuple = BLOCK_PATTERNS
    begging: tuple = BEGGING_PATTERNS
    whitelist: tuple = ZONE_WHITELIST
    hide_tiers: tuple = ("junk",)
    hide_unproven: bool = False
    low_view_suppresses_tier: bool = True
    index_pass_exempts: bool = True
    live_column: str | None = None
    official_column: str | None = None


# Named works and characters whose titles stay out of the catalogue, as patterns over folded titles.
TOPIC_NAMES = (
    "原神", "崩坏", "星穹", "星铁", "绝区零", "未定事件簿", "明日方舟", "蔚蓝档案", "碧蓝档案", r"blue\s*archive",
    "碧蓝航线", "少女前线", "公主连结", "fgo", r"fate\s*(?:/|系列|zero|stay)", "阴阳师", "战双", "鸣潮", "重返未来",
    "无期迷途", "第五人格", "偶像梦幻祭", "忘川风华录", "7日之都", "七日之都", "7都", "pjsk", "プロセカ", "世界计划", "边狱巴士", "limbus", "逆转裁判", "弹丸论破",
    "赛马娘", "东方project", "车万", "一目连", "茨木", "酒吞", "大天狗", "玉藻前", "妖刀姬", "御馔津", "彼岸花",
    "派蒙", "雷电将军", "钟离", "可莉", "胡桃", "甘雨", "芙宁娜", "纳西妲", "阿米娅", "凯尔希", "斯卡蒂", "史尔特尔",
    "璃月", "蒙德", "稻妻", "须弥", "枫丹", "纳塔", "开拓者", "旅行者", "愚人众", "执行官",
)


@dataclass(frozen=True)
class ScreenRules:
    """Title word lists used for routing a catalogue row to review."""

    topics: tuple = TOPIC_NAMES
    cues: tuple = MOTIVE_CUES
    title_words: tuple = TITLE_REVIEW_WORDS
    short_max: int = 150


@dataclass(frozen=True)
class Driver:
    """Stand-ins the registered queries use on the driver's tables (their titles are English words)."""

    capture_time: str = "2001-08-02 00:00:00"
    reference_cutoff: str = "1999-01-01 00:00:00"
    first_walk: str = "1992-02-01 00:00:00"
    tiers: TierRules = field(default_factory=lambda: TierRules(strong=("gizmo",), weak=("cold", "old", "rod")))
    feed: FeedRules = field(default_factory=lambda: FeedRules(
        block=("^red.*(rod|anvil)$", "^hot b"), begging=("small .{0,6}ring", "new g"), whitelist=("URGENT",)))
    screen: ScreenRules = field(default_factory=lambda: ScreenRules(
        topics=("thorre", "eauque", "ungen", r"blue\s*eth"), cues=("hot", "cold", "old", "plate", "ring"), title_words=("anvil", "large bolt")))


DRIVER = Driver()

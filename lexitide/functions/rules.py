"""Fixed values of caption cutting and look-up: word lists, limits, phrase rules. They are data, and must be as they are."""

# Words that should not end a caption, and that alone make an orphan.
FUNCTION_WORDS = (
    "a an the to of with for from into on in at by and but or because that which who whom whose when if as my your his her our their "
    "am is are was were be been being have has had do does did can could will would shall should may might must"
).split()
# Words that continue a clause.
CONTINUATIONS = "of to from for with without than that which who whom whose what where when why how".split()
# Weak endings of the greedy cut (a longer list than FUNCTION_WORDS).
WEAK_ENDINGS = (
    "a an the to of with for from into on in at by and but or because that which who whom whose when if as i you he she it we they this these those there "
    "my your his her our their very really just kind sort much many more most less good not no so too quite am is are was were be been being have has had "
    "do does did can could will would shall should may might must"
).split()
# Openings of dependent clauses, and of clauses after which a break is preferred.
DEPENDENT = "even though,although,because,if,unless,while,when,whenever,since".split(",")
CLAUSE_BREAKS = "and but so because although though while which who when where then however".split()
CLAUSE_SCORES = "and but so because although which who when then".split()
# Dependency labels within which no break falls, and part-of-speech pairs between which none falls.
PROTECTED_DEPENDENCIES = "amod det compound poss case aux auxpass prt prep pobj dobj attr nummod neg".split()
PROTECTED_PAIRS = [("DET", "NOUN"), ("DET", "PROPN"), ("ADJ", "NOUN"), ("ADJ", "PROPN"), ("AUX", "VERB"), ("PART", "VERB"), ("ADP", "DET"), ("ADP", "NOUN"), ("ADP", "PROPN"), ("NUM", "NOUN"), ("PROPN", "PROPN")]

# Limits in ms, words and characters.
MIN_MS, TARGET_MS, PREFERRED_MS, MAX_MS = 1200, 5800, 8500, 12000
PREFERRED_WORDS, MAX_WORDS, PREFERRED_CHARS, MAX_CHARS = 24, 30, 140, 160
SOFT_GAP_MS, BREAK_GAP_MS, FORCED_GAP_MS, ORPHAN_GAP_MS = 320, 750, 1200, 5000
ORPHAN_PROBABILITY, CHUNK_WORDS = 0.58, 180
START_PAD_MS, END_PAD_MS, MIN_GAP_MS, LEAST_MS = 30, 220, 30, 200

# Ordered corrections of recognised text (pattern, replacement).
CORRECTIONS = [
    (r"\bthis\s+is\s+the\s+lost\s+way\s+around\s+africa\b", "This is the long way around Africa"),
    (r"\bthe\s+lost\s+way\s+around\s+africa\b", "the long way around Africa"),
    (r"\blost\s+way\s+around\s+africa\b", "long way around Africa"),
    (r"\bgoogle\s+maps\s+it\b", "Google Maps it"),
    (r"\bwith\s+the\s*,\s*with\s+the\b", "with the"),
]
# Ordered glossary applied before translation.
GLOSSARY = [
    (r"\bthe\s+lost\s+way\s+around\s+africa\b", "the long way around Africa"),
    (r"\blost\s+way\s+around\s+africa\b", "long way around Africa"),
    (r"\bas\s+the\s+crow\s+flies\b", "in a straight line"),
    (r"\bgoogle\s+maps\s+it\b", "use Google Maps to figure it out"),
    (r"\bgoogle-map\s+it\b", "use Google Maps to figure it out"),
    (r"\bcoast\s+to\s+coast\b", "from one coast to the other coast"),
    (r"\bDCF\b", "Dyneema Composite Fabric (DCF)"),
    (r"\bstrength\s+to\s+weight\s+ratio\b", "strength-to-weight ratio"),
    (r"\brunner['’]s\s+high\b", "the euphoric feeling known as runner's high"),
    (r"\bhiker['’]s\s+high\b", "the euphoric feeling known as hiker's high"),
    (r"\btrekking\s+poles?\b", "hiking trekking poles"),
    (r"\bbackpacking\s+quilts?\b", "insulated backpacking quilts"),
]
# Term fixes of Chinese captions.
CJK_TERMS = [
    ("抓住你的背包", "带上你的背包"),
    ("包装了我们的熊喷雾", "带上了防熊喷雾"),
    ("包装熊喷雾", "带上防熊喷雾"),
    ("冬季克", "冬季夹克"),
    ("露营旅行", "露营之旅"),
    ("露营是有趣的", "露营很有趣"),
    ("让我们这样做", "我们出发吧"),
]
CJK = r"[㐀-鿿]"

# Whole sentences (patterns) and their translation.
SENTENCES = [
    (r"\bjoin me and my family today as we go on a camping and hiking\.?$", "今天和我及家人一起去露营徒步吧。"),
    (r"\btrip to a beautiful glacier lake in canada\.?$", "前往加拿大一座美丽的冰川湖。"),
    (r"\bso grab your backpack,?\.?$", "所以带上你的背包，"),
    (r"\ba tent,? your hiking boots,?\.?$", "一顶帐篷和你的徒步靴，"),
    (r"\band (let['’]s do it|let us go)\.?$", "我们出发吧。"),
    (r"\byou['’]re also going to need a good, warm winter jacket and sleeping bag\.?$", "你还需要一件保暖的冬季夹克和一个睡袋。"),
    (r"\boh my\.?$", "天啊。"),
    (r"\bbut we don't get to go straight (as the crow flies|in a straight line)\.?$", "但我们不能按直线距离直接过去。"),
    (r"\bthis is the (lost|long) way around africa\.?$", "这就是绕行非洲的漫长路线。"),
    (r"\bif you're going to cross africa (coast to coast|from one coast to the other coast), you're going to need to do some planning\.?$", "如果你要横穿非洲，从一个海岸到另一个海岸，就得认真规划。"),
    (r"\bsome serious planning\.?$", "而且是非常认真的规划。"),
    (r"\byou see, you can't just (google maps it|use google maps to figure it out)\.?$", "你看，这事不能只是打开谷歌地图随便搜一下就出发。"),
]
# Sources (patterns) whose translations have these fragments put right.
GUARDED_FRAGMENTS = [
    (
        r"\bbut we don't get to go straight (as the crow flies|in a straight line)\b",
        [("但是我们不能直走一条直线", "但我们不能按直线距离直接过去"), ("但我们不能直走一条直线", "但我们不能按直线距离直接过去"), ("但我们不能直接走直线", "但我们不能按直线距离直接过去")],
    ),
    (
        r"\bthis is the (lost|long) way around africa\b",
        [("这是非洲最远的路", "这就是绕行非洲的漫长路线"), ("这是在非洲各地的迷路", "这就是绕行非洲的漫长路线"), ("这是非洲各地的迷路", "这就是绕行非洲的漫长路线")],
    ),
    (
        r"\bif you're going to cross africa (coast to coast|from one coast to the other coast)\b",
        [
            ("如果你要从一个海岸穿越非洲到另一个海岸, 你需要做一些计划", "如果你要横穿非洲，从一个海岸到另一个海岸，就得认真规划"),
            ("如果你要穿越非洲海岸到海岸，你需要做一些规划", "如果你要横穿非洲，从一个海岸到另一个海岸，就得认真规划"),
        ],
    ),
    (
        r"\byou see, you can't just (google maps it|use google maps to figure it out)\b",
        [("你不能只用谷歌地图来弄清楚", "你看，这事不能只是打开谷歌地图随便搜一下就出发"), ("你看，你不能只是谷歌地图它", "你看，这事不能只是打开谷歌地图随便搜一下就出发")],
    ),
]
# Fragments put right in every translation, in this order.
FRAGMENTS = [
    ("但是我们不能直走一条直线", "但我们不能按直线距离直接过去"),
    ("但我们不能直走一条直线", "但我们不能按直线距离直接过去"),
    ("这是非洲最远的路", "这就是绕行非洲的漫长路线"),
    ("像乌鸦飞来飞去一样直走", "按直线距离直接过去"),
    ("像乌鸦飞一样直走", "按直线距离直接过去"),
    ("乌鸦飞", "直线距离"),
    ("非洲各地的迷路", "绕行非洲的漫长路线"),
    ("非洲各地的失落之路", "绕行非洲的漫长路线"),
    ("海岸到海岸", "从一个海岸到另一个海岸"),
    ("一些严肃的计划", "非常认真的规划"),
    ("谷歌地图它", "用谷歌地图随便搜一下"),
    ("谷歌地图一下", "用谷歌地图随便搜一下"),
]

"""Closed vocabularies and weights of the data model, as plain values."""

from __future__ import annotations

# Vocabularies of the feature row.
CATEGORIES = ("movie", "sports", "tech", "lifestyle", "money", "other")
MOODS = (
    "tense", "uplifting", "mysterious", "epic", "melancholic", "energetic", "calm", "aggressive",
    "romantic", "nostalgic", "ominous", "joyful", "neutral", "dramatic", "playful", "sinister",
)
ENERGY = ("low", "medium", "high")
LIGHTING = ("low-key", "high-key", "natural", "neon", "golden-hour", "mixed")
SHOT_TYPES = ("wide", "medium", "close-up", "extreme-close-up", "aerial", "overhead", "two-shot")
CAMERA_MOTION = ("static", "pan", "tilt", "dolly", "handheld", "tracking", "zoom")
DEPTH_OF_FIELD = ("deep", "shallow")
SOURCES = ("library", "reference", "youtube")
LIST_CAPS = {"subjects": 3, "setting": 2, "action": 2, "mood": 3, "color_palette": 3}
ENUM_DEFAULTS = {
    "category": "other", "energy": "medium", "lighting": "natural", "shot_type": "wide",
    "camera_motion": "static", "depth_of_field": "deep", "source": "library",
}
ENUMS = {
    "category": CATEGORIES, "energy": ENERGY, "lighting": LIGHTING, "shot_type": SHOT_TYPES,
    "camera_motion": CAMERA_MOTION, "depth_of_field": DEPTH_OF_FIELD,
}
NUMERICS = (
    "palette_warmth", "palette_saturation", "palette_brightness", "motion_intensity", "contrast", "edge_density", "confidence",
)

# Pairs that count as compatible (either order).
LIGHTING_PAIRS = (("low-key", "natural"), ("high-key", "natural"), ("neon", "mixed"), ("golden-hour", "natural"))
SHOT_PAIRS = (("close-up", "extreme-close-up"), ("wide", "medium"), ("aerial", "overhead"))
MOTION_PAIRS = (("pan", "tilt"), ("dolly", "tracking"))
CATEGORY_PAIRS = (("sports", "lifestyle"), ("money", "lifestyle"))
SHOT_NEIGHBOURS = (
    ("wide", "medium"), ("medium", "close-up"), ("close-up", "extreme-close-up"), ("close-up", "two-shot"), ("aerial", "overhead"),
)
ENERGY_STEPS = (("low", "medium"), ("medium", "high"))
MOOD_GROUPS = (
    ("mysterious", "ominous"), ("energetic", "aggressive"), ("calm", "melancholic"), ("joyful", "uplifting"), ("epic", "dramatic"),
)
VIBE_NEIGHBOURS = (
    ("low-key", "mixed"), ("high-key", "mixed"), ("low", "medium"), ("high", "medium"), ("wide", "medium"), ("wide", "aerial"),
    ("medium", "close-up"), ("close-up", "extreme-close-up"), ("aerial", "overhead"), ("shallow", "deep"),
)
WIDE_SHOTS, TIGHT_SHOTS = ("wide", "aerial", "overhead"), ("close-up", "extreme-close-up", "two-shot")
MOTION_CONTRASTS = (
    ("static", "dolly"), ("static", "handheld"), ("static", "tracking"), ("static", "pan"), ("static", "tilt"),
    ("static", "zoom"), ("dolly", "tracking"),
)

# Titles that mark a search result as junk.
JUNK_TERMS = (
    "podcast", "reaction", "react", "explained", "interview", "tutorial", "how to", "review", "vlog", "story time",
    "storytime", "q&a", "commentary", "tier list", "ranking", "compilation of", "top 10", "top ten",
)

# Words of file names that are no tags, and marks of folders with the category they stand for.
PATH_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "b", "best", "big", "roll", "broll", "by", "clip", "clips", "compilation", "edit",
    "edits", "for", "from", "full", "hd", "high", "hq", "in", "is", "of", "official", "on", "quality", "rare", "short",
    "shorts", "the", "to", "video", "with",
)
FOLDER_CATEGORIES = (("good stuff", "movie"), ("nba", "sports"), ("ronaldo", "sports"))

# Words and phrases of the default text profile.
HOOK_WORDS = (
    "secret", "mistake", "kill", "kills", "never", "why", "how", "money", "million", "billion", "trillion", "dollar", "ai",
    "best", "worst", "crazy", "insane", "truth", "actually", "problem", "failed", "failure", "success", "startup", "company",
    "business", "bezos", "musk", "jobs", "ford",
)
TERM_WEIGHTS = {
    "secret": 4.0, "rule": 3.5, "mistake": 3.5, "revealed": 3.0, "hidden": 3.0, "truth": 2.8, "wrong": 2.5, "never": 2.5,
    "why": 2.0, "how": 2.0, "bullshit": 3.5, "kill": 3.0, "kills": 3.0, "trillion": 3.0, "billion": 2.5, "million": 2.0,
    "ai": 2.5, "amazon": 2.5, "apple": 2.5, "iphone": 2.5, "bezos": 2.5, "musk": 2.5, "jobs": 2.5, "ford": 2.5,
    "founder": 2.0, "company": 1.8, "startup": 1.8,
}
PHRASE_WEIGHTS = {
    "work life balance": 4.0, "work life harmony": 4.5, "trillion dollar company": 4.0, "secret rule": 3.5,
    "secret technique": 3.5, "faster horses": 3.5, "built amazon": 3.0, "built apple": 3.0, "built the iphone": 3.0,
    "don't ask customers": 3.0,
}
# Words that mark learned terms and phrases as hooks.
SEED_WORDS = (
    "secret", "rule", "technique", "mistake", "hidden", "revealed", "never", "wrong", "truth", "bullshit", "kill", "kills", "ai",
    "money", "million", "billion", "trillion", "startup", "founder", "company", "amazon", "apple", "iphone", "bezos", "musk",
    "jobs", "ford",
)
# Words that no learned term is and no learned phrase begins or ends with.
STOP_WORDS = (
    "a", "about", "after", "all", "an", "and", "are", "as", "at", "be", "because", "but", "by", "can", "did", "do", "does",
    "for", "from", "had", "has", "have", "he", "her", "his", "i", "if", "in", "is", "it", "its", "just", "like", "not", "of",
    "on", "or", "people", "she", "so", "that", "the", "their", "they", "this", "to", "was", "we", "what", "when", "who", "why",
    "will", "with", "would", "you", "your",
)

# Words that are no part of a person's name in a title.
NAME_STOP_WORDS = (
    "A", "About", "After", "AI", "An", "And", "Are", "Balance", "Bought", "Built", "Business", "Can", "Caring", "Changed",
    "Company", "Companies", "Committee", "Could", "Customers", "Day", "Dollar", "Every", "Everything", "Explains", "Fallout",
    "For", "From", "Get", "Hacked", "He", "Her", "Here", "His", "How", "Into", "Invest", "Is", "It", "Kills", "Minute",
    "Million", "Never", "Of", "Painted", "Per", "Proves", "Revealed", "Reveals", "Rule", "Says", "Secret", "She", "Should",
    "Technique", "The", "This", "To", "Trillion", "University", "Was", "Watching", "What", "When", "Will", "Why", "Would",
    "With", "Without", "Works", "Billion",
)

# Words too weak to be highlighted.
WEAK_WORDS = (
    "a", "an", "and", "are", "for", "from", "he", "her", "his", "how", "i", "in", "is", "it", "of", "on", "she", "that", "the",
    "this", "to", "was", "what", "when", "why", "with", "without", "you",
)

# Patterns of numbers and words in titles.
TITLE_NUMBER = r"\$?[0-9][0-9,.]*(?:h\+?|k|m|b|%|am|pm|x|\+)?"
TITLE_WORD = r"[A-Za-z][A-Za-z'.-]*|\$?[0-9][\w,.%+:-]*"

# Seconds of the job stages, in order, and how long each may go without an update.
STAGE_SECONDS = {"ingested": 1.0, "analyzing": 25.0, "transcribing": 8.0, "selecting": 2.0, "titling": 2.0, "broll_recovery": 25.0, "rendering": 35.0}
STAGE_LIMITS = {
    "ingested": 180.0, "analyzing": 600.0, "transcribing": 300.0, "selecting": 120.0, "titling": 120.0,
    "broll_recovery": 1200.0, "rendering": 600.0,
}
STUCK_SECONDS, TERMINAL = 900.0, ("ready", "failed")

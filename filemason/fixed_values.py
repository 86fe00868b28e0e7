"""Fixed values.

Word lists, lookup tables, patterns and formats that decide results. They are data, not
logic, and must keep exactly these entries for the results to agree with earlier runs.
"""

# File type by extension; anything else is "other".
EXTENSIONS_BY_TYPE = {
    "document": [".txt", ".md", ".pdf", ".doc", ".docx", ".rtf", ".odt"],
    "image": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp", ".svg"],
    "video": [".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm"],
    "audio": [".mp3", ".wav", ".flac", ".aac", ".ogg", ".wma"],
    "archive": [".zip", ".rar", ".7z", ".tar", ".gz", ".bz2"],
    "code": [".py", ".js", ".html", ".css", ".java", ".cpp", ".c", ".php"],
}
FILE_TYPES = ["document", "image", "video", "audio", "archive", "code", "other"]
TEXT_TYPES = ["document", "code"]

# Order in which the kinds of action run.
ACTION_ORDER = ["create_dir", "copy", "move", "rename", "delete"]

# Name hints and patterns of the metadata features.
DOWNLOAD_HINTS = ["download", "temp", "tmp"]
SCREENSHOT_HINTS = ["screenshot", "screen shot", "capture"]
BACKUP_HINTS = ["backup", "copy", "bak"]
DATE_PATTERNS = [r"\d{4}-\d{2}-\d{2}", r"\d{2}-\d{2}-\d{4}", r"\d{8}"]
VERSION_PATTERNS = [r"v\d+", r"_\d+$", r"\(\d+\)"]
DATE_FLAGS = {
    "date_dash": r"\d{4}-\d{2}-\d{2}",
    "date_slash": r"\d{2}-\d{2}-\d{4}",
    "date_compact": r"\d{8}",
    "date_underscore": r"\d{4}_\d{2}_\d{2}",
}
ONE_HOT_EXTENSIONS = [".txt", ".pdf", ".jpg", ".png", ".mp4", ".zip", ".docx"]
NAME_WORD_SPLIT = r"[_\-\s\.]+"

# Words that are never keywords; keywords are longer than two characters.
KEYWORD_STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
CLUSTER_NAME_STOP_WORDS = ["file", "document", "image", "the", "and", "or"]

# The ordered rules. Words are tested as substrings of the lower-case name.
SYSTEM_NAMES = [
    ".ds_store", "thumbs.db", "desktop.ini", ".localized", "icon\r", "folder.jpg", "albumartsmall.jpg",
]
TEMP_WORDS = ["untitled", "new text document", "new document", "copy of copy", "temp", "tmp", "~"]
TEMP_EXTENSIONS = [".tmp", ".temp", ".bak", ".old"]
DUPLICATE_STEM_PATTERNS = [r"\(\d+\)", r"_copy", r"copy of"]
FINANCIAL_WORDS = [
    "invoice", "receipt", "bill", "statement", "tax", "budget", "expense", "income", "salary", "pay",
    "bank", "credit", "loan", "mortgage", "insurance", "investment", "portfolio", "retirement", "401k",
]
WORK_WORDS = [
    "meeting", "agenda", "project", "report", "proposal", "presentation", "contract", "agreement", "memo",
    "quarterly", "annual", "performance", "review", "team", "employee", "client", "customer", "business",
]
PERSONAL_WORDS = [
    "recipe", "workout", "health", "medical", "doctor", "vacation", "travel", "trip", "hotel", "flight",
    "family", "wedding", "birthday", "anniversary", "hobby", "book", "reading", "todo", "list",
    "personal", "diary", "journal", "note",
]
EDUCATION_WORDS = [
    "course", "lesson", "tutorial", "study", "notes", "learning", "education", "school", "university",
    "certificate", "diploma", "degree", "training", "programming", "python", "javascript",
    "machine learning", "data science", "statistics", "math", "algorithm",
]
SCREENSHOT_WORDS = ["screenshot", "screen shot", "screen capture", "capture", "snip", "grab"]
SCREENSHOT_PATTERN = r"screenshot.*\d{4}-\d{2}-\d{2}"
CAMERA_PATTERNS = [r"^img_\d+", r"^dsc\d+", r"^dcim", r"^\d{8}_\d+"]
SOCIAL_WORDS = [
    "instagram", "facebook", "twitter", "linkedin", "snapchat", "tiktok", "social", "profile",
    "avatar", "cover", "story", "post", "meme",
]
VIDEO_FOLDERS = [
    (["tutorial", "course", "lesson", "education"], "Media/Videos/Educational"),
    (["meeting", "conference", "presentation"], "Media/Videos/Work"),
    (["movie", "film", "show", "entertainment"], "Media/Videos/Entertainment"),
    ([], "Media/Videos"),
]
AUDIO_FOLDERS = [
    (["podcast", "interview", "talk"], "Media/Audio/Podcasts"),
    (["song", "music", "album", "track"], "Media/Audio/Music"),
    (["meeting", "recording", "note"], "Media/Audio/Recordings"),
    ([], "Media/Audio"),
]
ARCHIVE_FOLDERS = [
    (["backup", "archive", "old"], "Software/Archives/Backups"),
    (["project", "source", "code"], "Software/Archives/Projects"),
    ([], "Software/Archives"),
]
INSTALLER_EXTENSIONS = [".exe", ".msi", ".dmg", ".pkg", ".deb", ".rpm"]
INSTALLER_WORDS = ["installer", "setup", "install"]
CODE_FOLDERS = [
    ([".py"], "Code/Python"),
    ([".js", ".jsx", ".ts", ".tsx"], "Code/JavaScript"),
    ([".html", ".css"], "Code/Web"),
    ([".java"], "Code/Java"),
    ([".cpp", ".c", ".h"], "Code/C_CPP"),
    ([], "Code/Other"),
]
TYPE_FOLDERS = {
    "document": "Documents/General", "image": "Images/General", "video": "Media/Videos",
    "audio": "Media/Audio", "archive": "Software/Archives", "code": "Code", "other": "Other",
}
OLD_AGE_DAYS, OLDER_AGE_DAYS = 365, 90
BASE_DIRECTORIES = [
    "Documents/Work", "Documents/Personal", "Documents/Financial", "Documents/Educational",
    "Images/Screenshots", "Images/Photos/Camera", "Images/Photos/Social_Media", "Images/Graphics",
    "Media/Videos", "Media/Audio", "Software/Installers", "Software/Archives", "Code",
    "System_Files", "Archive/Old_Files", "_Needs_Review",
]

# USD per 1000 tokens (input, output), and the model priced when one is unknown.
PRICES = {
    ("openai", "gpt-3.5-turbo"): (0.0005, 0.0015),
    ("openai", "gpt-4"): (0.03, 0.06),
    ("openai", "gpt-4-turbo"): (0.01, 0.03),
    ("anthropic", "claude-3-haiku"): (0.00025, 0.00125),
    ("anthropic", "claude-3-sonnet"): (0.003, 0.015),
    ("anthropic", "claude-3-opus"): (0.015, 0.075),
}
DEFAULT_MODELS = {"openai": "gpt-3.5-turbo", "anthropic": "claude-3-haiku"}

# Categories and folders of the metadata-only summaries.
CATEGORY_WORDS = [
    ("Work", ["meeting", "project", "report", "presentation"]),
    ("Personal", ["personal", "family", "vacation", "recipe"]),
    ("Financial", ["invoice", "receipt", "tax", "budget"]),
    ("Educational", ["course", "tutorial", "study", "notes"]),
]
CATEGORY_BY_TYPE = {"image": "Media", "video": "Media", "audio": "Media", "code": "Technical"}
SUMMARY_FOLDER_BY_TYPE = {
    "document": "Documents", "image": "Images", "video": "Videos", "audio": "Audio",
    "code": "Code", "archive": "Archives", "other": "Other",
}
CATEGORY_DIRECTORIES = {
    "work": ["Work/Projects", "Work/Documents"],
    "personal": ["Personal/Documents", "Personal/Photos"],
    "financial": ["Finance"],
    "educational": ["Education"],
}
WORK_CATEGORIES = ["work", "business", "professional"]
PERSONAL_CATEGORIES = ["personal", "family", "home"]

#: The English stop words that Spark's StopWordsRemover loads by default (Apache Spark, public list).
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll "
    "we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've "
    "they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't "
    "mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's "
    "would "
).split()

"""Word lists, tables, limits, patterns and formats.

They are part of the corpus contract; results are only comparable when they
are exactly these. Nothing in this module computes anything.
"""

# --- fixed values: file types ------------------------------------------------
TEXT_EXTS = (".txt", ".md")
HTML_EXTS = (".html", ".htm")
PDF_EXTS = (".pdf",)
SLIDE_EXTS = (".pptx",)
WORD_EXTS = (".docx",)
SHEET_EXTS = (".xlsx", ".xlsm")
CSV_EXTS = (".csv",)
VIDEO_EXTS = (".mp4", ".mkv", ".webm", ".mov", ".avi")
AUDIO_EXTS = (".mp3", ".m4a", ".wav", ".aac", ".flac", ".ogg")
SUBTITLE_EXTS = (".srt", ".vtt")
SHORTCUT_EXTS = (".url",)
JSON_EXTS = (".json",)
NO_EXTENSION = "[no extension]"

# --- fixed values: canonical order of sources (rank 0 is a file "content.txt")
CONTENT_TEXT_NAME = "content.txt"
CONTENT_NAMES = ("content.txt", "content.html", "content.htm")
RANK_OTHER = 9

# --- fixed values: retrieval priority by source type, 5 when not listed ------
SOURCE_PRIORITY = {
    "lms_page": 1,
    "lms_text": 1,
    "word_document": 1,
    "spreadsheet": 1,
    "csv_table": 1,
    "slide": 2,
    "lecture_pdf": 2,
    "subtitle": 3,
    "video_transcript": 3,
    "media": 3,
    "reference_pdf": 4,
    "reference_text": 4,
    "other": 5,
}

# --- fixed values: source families -------------------------------------------
LECTURER_TYPES = (
    "lms_page", "lms_text", "lecture_pdf", "slide", "reference_pdf", "reference_text",
    "word_document", "spreadsheet", "csv_table", "subtitle", "video_transcript",
)
VISUAL_TYPES = ("lecture_pdf", "slide", "word_document", "spreadsheet")

# --- fixed values: names skipped while listing files --------------------------
SKIP_DIRS = ("AI_Knowledge", "__MACOSX", ".git", ".idea", ".vscode", "node_modules")
METADATA_PATHS = (
    "_meta/course_structure.json", "_meta/download_manifest.json", "_meta/stats.json",
    "_meta/_course_structure.json", "_meta/_download_manifest.json", "_meta/_stats.json",
)
METADATA_NAMES = ("_course_structure.json", "_download_manifest.json", "_stats.json")

# --- fixed values: path hints for groups --------------------------------------
COURSE_INFO_HINTS = (
    "course syllabus", "general information", "course outline", "grading", "final exam",
    "thi cuối kỳ", "thông tin môn học", "overview", "description",
    "books and references", "announcements", "chung",
)
REFERENCE_HINTS = (
    "textbook", "books and references", "book and reference", "references", "cisco ccie",
    "routing tcp", "prentice hall", "top-down approach", "top down approach",
)
CHAPTER_RANGE = (
    r"(?i)(?<![a-z])(?:chapter|ch)\s*0*(\d{1,2})\s*"
    r"(?:[_\-–—&]|\band\b|\bto\b)\s*(?:(?:chapter|ch)\s*)?0*(\d{1,2})"
)
CHAPTER_RANGE_STRICT = CHAPTER_RANGE + r"(?!\d)"
CHAPTER_SINGLE = r"(?i)(?<![a-z])(?:chapter|ch)\s*0*(\d{1,2})"

# --- fixed values: section buckets, tried in this order ------------------------
SECTION_BUCKETS = (
    ("labs", r"\b(lab|laboratory|practical|thuc hanh)\b"),
    ("assignments", r"\b(assignment|homework|exercise|project|report|bai tap|btl|do an)\b"),
    ("references", r"\b(textbook|reference|references|book|books|tai lieu tham khao|reading|readings)\b"),
    ("lectures", r"\b(chapter|lecture|slide|slides|week|tuan|chuong|bai giang|lesson|module|content|contents)\b"),
    ("course_info", r"\b(chung|general|announcement|announcements|overview|syllabus|course syllabus|"
                    r"course information|course info|description|grading|gioi thieu|thong tin mon hoc|"
                    r"final exam|thi cuoi ky|exam info)\b"),
)

# --- fixed values: limits -----------------------------------------------------
DEDUP_MIN_CHARS = 80
CHUNK_MAX_CHARS = 4800
CHUNK_OVERLAP = 500
STUB_MAX_WORDS = 80
LARGEST_SHOWN = 30
EXAMS_KEPT = 4
EXAMS_PER_TYPE = 2
EXAM_BYTES = 15 * 1024 * 1024
SIMILARITY_MIN = 0.70
PAGE_DISTANCE_MAX = 8
ALIGN_GAP = 12
ALIGN_SHARE = 0.98
CONVERSION_MIN_SOURCE = 1024 * 1024
CONVERSION_MIN_SAVING = 1024 * 1024
CONVERSION_MIN_RATIO = 0.10
TARGET_BYTES = 95_000_000
PAGE_TEXT_MIN = 200
PAGE_TEXT_LOW = 80
PAGE_DRAWINGS_MAX = 20
ACTIVE_COURSE_MAX = 0.98
THROTTLE_SECONDS = 2

# --- fixed values: redaction patterns and replacements, in order of use --------
REDACT_LOG = (
    (r"""(?i)\b(cookie|set-cookie|authorization)["']?\s*[:=]\s*[^\r\n]+""", "$1: [REDACTED]"),
    (r"""(?i)\b(moodlesession[a-z0-9_]*|sessionid|sesskey|access_token|token|password|passwd)["']?\s*[:=]\s*["']?[^\s;&,"']+""",
     "$1=[REDACTED]"),
)
REDACT_CRAWL = (
    (r"""(?i)(https?)://(?:[^\s<>"'/?#@]*@)?([^\s<>"'/?#]*)([^\s<>"'?#;]*)[^\s<>"']*""", "$1://$2$3"),
    (r"(?i)\b(authorization|proxy-authorization)\s*[:=]\s*(?:bearer|basic)\s+\S+", "$1=[redacted]"),
    (r"(?i)\b(cookie|set-cookie)\s*[:=]\s*[^\r\n]+", "$1=[redacted]"),
    (r"(?i)\b(access[_-]?token|refresh[_-]?token|token|session(?:id|[_-]?id)?|sesskey)\s*[:=]\s*[^\s,;]+",
     "$1=[redacted]"),
)
REDACT_PIPELINE = (
    (r"(?i)(authorization|proxy-authorization)\s*[:=]\s*(?:bearer|basic)\s+\S+", "$1=[redacted]"),
    (r"(?i)\b(cookie|set-cookie|token|sessionid|sesskey)\s*[:=]\s*\S+", "$1=[redacted]"),
    (r"(?i)(https?://[^\s?#]+)(?:\?[^\s#]*)?(?:#[^\s]*)?", "$1"),
    (r"""(?i)\b[A-Z]:[\\/][^\s"'<>)]*""", "[local path]"),
    (r"""(?i)/(?:Users|home)/[^\s"'<>)]*""", "[local path]"),
)
REDACT_PATH = (
    (r"(?i)\b(authorization|proxy-authorization|cookie|set-cookie|access[_-]?token|refresh[_-]?token|token|sessionid|sesskey)([=:])[^/\\]*",
     "$1$2[redacted]"),
)
FAILURE_TITLE_DEFAULT = "Untitled resource"
FAILURE_REASON_DEFAULT = "Unknown error"
ABSOLUTE_PATH = r"(?im)(?:\b[A-Z]:[\\/]|/(?:Users|home)/)"

# --- fixed values: URLs -------------------------------------------------------
COURSE_PATH_SUFFIX = "/course/view.php"
FILE_MARKERS = ("/pluginfile.php/", "/draftfile.php/")
INTERACTIVE_TYPES = (
    "forum", "assign", "quiz", "choice", "feedback", "workshop", "attendance", "chat",
    "survey", "questionnaire", "scheduler",
)
DEEP_TYPES = ("page", "folder", "book", "url", "lesson", "resource")
FILE_SUFFIXES = (
    ".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx",
    ".zip", ".rar", ".7z", ".txt", ".csv", ".json", ".xml",
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg",
    ".mp4", ".mkv", ".webm", ".mov", ".avi", ".m4v", ".mp3", ".wav", ".m4a",
    ".py", ".java", ".c", ".cpp", ".h", ".kt", ".ipynb",
)
VIDEO_URL_SUFFIXES = (".mp4", ".mkv", ".webm", ".mov", ".avi", ".m4v")
PUBLIC_FILE_HOSTS = ("drive.google.com", "docs.google.com")
REDIRECT_HOSTS = ("google.com", "www.google.com")
REDIRECT_PATH = "/url"
PUBLIC_FILE_ID = r"/(?:file|document|spreadsheets|presentation)/d/([^/?#]+)"
PUBLIC_FOLDER_ID = r"/folders/([^/?#]+)"

# --- fixed values: exam words -------------------------------------------------
EXAM_CONTEXT = (
    "de thi", "de cac nam", "exam", "exams", "past exam", "past exams", "midterm", "mid term",
    "giua ky", "giua ki", "gk", "final", "finals", "cuoi ky", "cuoi ki", "ck",
)
MIDTERM_PHRASES = ("midterm", "mid term", "giua ky", "giua ki", "thi giua ky", "de giua ky", "gk")
MIDTERM_SURE = ("gk", "midterm", "mid term", "thi giua ky", "de giua ky")
FINAL_PHRASES = ("final", "final exam", "thi cuoi ky", "de cuoi ky", "cuoi ky", "cuoi ki", "ck")
FINAL_SURE = ("ck", "final exam", "exam final", "thi cuoi ky", "de cuoi ky")
PARENT_FOLDER_HINTS = ("tai lieu", "document", "archive", "semester", "year", "nam hoc", "hoc ky", "hk")
OFFICIAL_WORDS = ("chinh thuc", "official")
SAMPLE_WORDS = ("minh hoa", "sample", "demo")
EXAM_SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".txt", ".docx", ".pptx")
TERM_YEARS = r"20\d{2}\s*-\s*20\d{2}"
TERM_TOKEN = r" ((?:hk)?\d{3}|20\d{2}) "
INCOMPLETE_STATES = (
    "overall_timeout", "node_limit", "depth_limit", "timeout", "cancelled", "invalid_source",
    "http_fetch_failed", "permission_denied", "browser_render_failed",
)
EMPTY_STAGES = (
    "overall_timeout", "node_limit", "depth_limit", "permission_denied", "browser_render_failed",
    "timeout", "public_empty", "public_enumerated",
)

# --- fixed values: catalog table headers (folded) ------------------------------
CATALOG_HEADERS = {
    "ma": "code", "ma mon": "code", "ma hp": "code", "ma hoc phan": "code",
    "course code": "code", "course id": "code",
    "ten mon": "name", "ten mon hoc": "name", "ten hoc phan": "name", "course name": "name",
    "giang vien": "lecturer", "lecturer": "lecturer", "gv": "lecturer",
    "tai lieu": "material", "material": "material", "link": "material", "video": "material",
}
CATALOG_NAME_TAIL = r"\b(lop|class|nhom|group|nhom hoc|hoc ky|hk)\b.*$"
CATALOG_CODE = r"[A-Z]{1,5}\d{3,5}"
COURSE_CODE = r"(?i)(?<![A-Z0-9])([A-Z]{2,4}\d{3,6})(?![A-Z0-9])"

# --- fixed values: page structure ---------------------------------------------
TEXT_DROPPED_TAGS = ("script", "style", "noscript", "nav", "header", "footer", "button", "form")
CONTENT_DROPPED_TAGS = (
    "script", "style", "noscript", "nav", "header", "footer", "aside", "form", "button",
    "input", "textarea", "select", "svg",
)
CONTENT_DROPPED_CLASSES = (
    "drawer", "secondary-navigation", "activity-navigation", "action-menu", "dropdown-menu",
)
CONTENT_DROPPED_CLASS_PART = "breadcrumb"
HIDDEN_CLASSES = ("accesshide", "sr-only")
MEDIA_SRC_TAGS = ("img", "source", "video", "audio", "track")
# section elements, in this order, and what tells two of them apart
SECTION_NODES = (
    {"tag": "li", "classes": ("course-section",)},
    {"tag": "section", "classes": ("course-section",)},
    {"tag": "div", "classes": ("course-section",)},
    {"tag": "li", "classes": ("section", "main")},
)
SECTION_IDENTITY = ("id", "data-sectionid", "class")
# headings of a section, in this order
SECTION_HEADS = (
    {"attrs": {"data-for": "section_title"}},
    {"classes": ("sectionname",)},
    {"tag": "h2", "within": "course-section-header"},
    {"tag": "h3", "within": "course-section-header"},
    {"tag": "h2"},
    {"tag": "h3"},
)
SECTION_MENU_CLASS = "section_action_menu"
SECTION_TITLE_NOISE = ("Thu gọn toàn bộ", "Mở rộng tất cả", "Select section")
FIRST_SECTION_TITLE = "Chung"
DEFAULT_LABEL = "Tài liệu"

# --- fixed values: name repair -------------------------------------------------
MOJIBAKE_MARKERS = ("Ã", "Â", "Æ", "Ä", "áº", "á»", "â€", "ðŸ")
ILLEGAL_NAME_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
RESERVED_NAMES = (
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
)
NAME_MAX = 240

# --- fixed values: size audit --------------------------------------------------
NAVIGATION_NAMES = (
    "00_START_HERE.md", "01_COURSE_MAP.md", "02_TUTOR_PROTOCOL.md", "03_SOURCE_INDEX.md",
    "04_COVERAGE_TRACKER.md", "05_RESUME_STATE.md", "06_EXAM_INDEX.md",
)

# --- fixed values: decoding order after utf-8 ----------------------------------
LEGACY_ENCODINGS = ("utf-8-sig", "cp1258", "cp1252", "latin-1")

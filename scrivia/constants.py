"""Thresholds, word lists and transition tables: fixed values, needed for equal results."""

# Similarity thresholds.
DIRECT_HIGH, DIRECT_REVIEW = 0.55, 0.30
SEMANTIC_HIGH, SEMANTIC_REVIEW = 0.90, 0.82
REPORT_REVIEW_PERCENT, REPORT_HIGH_PERCENT = 30, 55
PRECHECK_REVIEW, PRECHECK_HIGH = 0.20, 0.35
CHUNK_WORDS, CHUNK_STRIDE, CHUNK_LEAST = 500, 450, 40
MINHASH_SEEDS, SHINGLE_WORDS, MOST_SHINGLES = 64, 5, 20_000

# Stop words of the language check.
TURKISH_STOPWORDS = ("ve", "bir", "bu", "için", "ile", "olarak", "olan", "gibi", "daha", "sistem")
ENGLISH_STOPWORDS = ("the", "and", "of", "to", "in", "is", "for", "with", "this", "system")

# Words that carry no meaning in a heading or rule name.
KEYWORD_STOPWORDS = (
    "raporu", "rapor", "kontrol", "kontrolü", "kuralı", "şartı", "zorunlu",
    "olması", "olmalı", "bulunması", "gereken", "ilgili", "genel", "asgari", "azami",
    "başlığı", "başlık", "bölümü", "bölüm",
)

# Folded phrases that show what a document alone cannot prove.
EXTERNAL_EVIDENCE_MARKERS = (
    "video", "youtube", "vimeo", "canli yayin", "canli demo", "canli sunum",
    "saha teslimi", "fiziksel teslim", "numune teslimi", "yerinde teslim",
    "portala yukle", "portal uzerinden yukle", "sisteme yukle", "cevrim ici form",
)
JUDGE_REVIEW_MARKERS = (
    "kurul karari", "komite karari", "juri takdiri", "juri karari",
    "hakem heyeti", "yonetim kurulu onayi", "degerlendirme kurulu",
)

# Verdicts by severity.
VERDICT_RANK = {"DEGERLENDIRILEMEDI": -1, "BASARILI": 0, "REVIZYON": 1, "KRITIK_HATA": 2}

# Competition life cycle.
COMPETITION_TRANSITIONS = {
    "draft_criteria": ("criteria_processing",),
    "criteria_processing": ("criteria_review",),
    "criteria_review": ("open",),
    "open": ("applications_closed",),
    "applications_closed": ("evaluating", "open"),
    "evaluating": ("decisions_frozen",),
    "decisions_frozen": ("results_published", "evaluating"),
    "results_published": ("archived",),
    "archived": (),
}

# Accented Latin letters and what they fold to.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"
# The search fold's letters.
SEARCH_FROM, SEARCH_TO = "ışğüöçâîû", "isguocaiu"

# File kinds, their labels and the extensions of each.
FILE_KINDS = {
    "pdf": ("PDF", ("pdf",)), "word": ("DOC", ("doc", "docx", "odt", "rtf")), "excel": ("XLS", ("xls", "xlsx", "ods", "csv")), "powerpoint": ("PPT", ("ppt", "pptx", "odp")),
    "image": ("IMG", ("png", "jpg", "jpeg", "gif", "webp", "svg", "bmp")), "text": ("TXT", ("txt", "md", "json")), "archive": ("ZIP", ("zip", "rar", "7z")),
    "video": ("VID", ("mp4", "mov", "avi", "mkv", "webm")), "other": ("DOSYA", ()),
}
SHOWS_EXTENSION = ("word", "excel", "powerpoint", "archive", "other")

# Permissions and the roles that hold them.
PERMISSIONS = {
    "manage_accounts": ("00",), "author_criteria": ("01",), "author_profile": ("01",), "publish_profile": ("01",), "read_profiles": ("01", "02", "04"),
    "submit_application": ("03",), "read_applications": ("02", "03", "04"), "read_application_file": ("02", "03"), "run_ai_prescreen": ("02",), "final_judgement": ("02",),
    "operations_dashboard": ("04",), "coordinate_evaluation": ("04",), "manage_competition_stage": ("01",), "toggle_competition_activation": ("01", "04"), "archive_competition": ("01",),
    "archive_application": ("02",), "flag_competition_priority": ("04",), "read_extractions": ("01", "04"), "read_timeline": ("01", "02", "04"),
}

# Check stages in order, verdict labels, and words of the generated lines.
STAGES = ("language_template", "headings_content", "category_similarity", "criteria_evidence")
STAGE_TITLES = ("Dil ve Şablon Uygunluğu", "Başlık ve İçerik Kontrolü", "Kategori Uygunluğu ve Benzerlik", "Kriter Bazlı Kanıt Çıkarma")
VERDICT_LABELS = {"BASARILI": "BAŞARILI", "REVIZYON": "REVİZYON", "KRITIK_HATA": "KRİTİK HATA", "DEGERLENDIRILEMEDI": "PDF'DEN DEĞERLENDİRİLEMEZ"}
VERIFIABILITY = ("PDF_DENETLENEBILIR", "HARICI_KANIT_GEREKLI", "HAKEM_KONTROLU_GEREKLI")
VIOLATION_ACTIONS = ("block", "warn", "jury", "unspecified")
LANGUAGE_LABELS = {"tr": "Türkçe", "en": "İngilizce"}
UNSTATED = "Belgede belirtilmemiş"
FILLED_CHARS, MOST_CRITERIA, EMBEDDING_DIM, EMBEDDING_BATCH = 200, 400, 768, 16
#: Rows of the stored analyses; the least recently used go beyond it.
CACHE_ROWS = 200

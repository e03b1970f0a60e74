"""Fixed values of the posting table: columns, codes, patterns and word lists."""

# The columns of the posting table, in order.
COLUMNS = ("id", "title", "rank", "university", "university_full", "department", "deadline", "is_new", "date_added", "reference", "position_type", "salary", "start_date", "apply_url", "description")

# Source, university code, id prefix, full name; in registry order.
UNIVERSITIES = (
    ("polyu", "PolyU", "POLYU", "Hong Kong Polytechnic University"),
    ("eduhk", "EdUHK", "EDUHK", "Education University of Hong Kong"),
    ("lingnan", "LU", "LU", "Lingnan University"),
    ("hku", "HKU", "HKU", "University of Hong Kong"),
    ("hkust", "HKUST", "HKUST", "HK University of Science & Technology"),
    ("cityu", "CityU", "CITYU", "City University of Hong Kong"),
    ("hkbu", "HKBU", "HKBU", "Hong Kong Baptist University"),
    ("cuhk", "CUHK", "CUHK", "Chinese University of Hong Kong"),
    ("hkmu", "HKMU", "HKMU", "Hong Kong Metropolitan University"),
    ("hsu", "HSU", "HSU", "Hang Seng University of Hong Kong"),
    ("sfu", "SFU", "SFU", "Saint Francis University"),
    ("hksyu", "HKSYU", "HKSYU", "Hong Kong Shue Yan University"),
)

# Date patterns in the order in which they are tried.
DATE_PATTERNS = ("d MMMM yyyy", "d MMM yyyy", "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d/MMM/yyyy", "MMMM d, yyyy", "MMM d, yyyy")

# Phrases in a lower-cased title and the rank of the first that it holds.
RANK_PHRASES = (
    ("teaching-track", "Lecturer"),
    ("chair professor", "Professor"),
    ("associate professor", "Associate Professor"),
    ("assistant professor", "Assistant Professor"),
    ("professor", "Professor"),
    ("postdoc", "Postdoctoral"),
    ("post-doctoral", "Postdoctoral"),
    ("post doctoral", "Postdoctoral"),
    ("research fellow", "Postdoctoral"),
    ("dean", "Senior Management"),
    ("provost", "Senior Management"),
    ("head of", "Senior Management"),
    ("vice-chancellor", "Senior Management"),
    ("vice chancellor", "Senior Management"),
    ("vice-president", "Senior Management"),
    ("vice president", "Senior Management"),
    ("teaching associate", "Teaching Assistant"),
    ("teaching assistant", "Teaching Assistant"),
    ("research engineer", "Research Assistant/Associate"),
    ("research assistant", "Research Assistant/Associate"),
    ("research associate", "Research Assistant/Associate"),
    ("research officer", "Research Assistant/Associate"),
    ("lecturer", "Lecturer"),
    ("teaching fellow", "Lecturer"),
    ("instructor", "Lecturer"),
    ("clinical", "Lecturer"),
)

# Words of a lower-cased title that make a post non-academic.
NON_ACADEMIC = (
    "officer", "manager", "executive", "clerk", "clerical", "administrative", "administrator", "accountant",
    "accounting", "librarian", "programmer", "technician", "nurse", "counsellor", "secretary", "attendant",
    "helper", "dental", "registrar", "coordinator", "consultant", "director", "procurement",
    "laboratory assistant", "lab assistant", "office assistant", "security", "systems analyst",
    "phlebotomist", "editor", "project assistant", "project associate", "project fellow", "project technical",
)

# Patterns that read a department from a title, and what the last one must not be.
DEPT_IN = r"\bin\s+([A-Za-z][A-Za-z0-9\s&,\-/()]+?)(?:\s*[/-]\s*(?:Post|Senior|Research|Lecturer|Professor|Assoc|Assis)|\s*\((?!Full|Part|several|multiple|part)|\s*$)"
DEPT_OF = r"\bof\s+([A-Z][A-Za-z0-9\s&,\-/]{4,60})"
DEPT_TAIL = r"\(([A-Za-z][A-Za-z0-9\s&,\-/]{4,60})\)\s*$"
NOT_DEPT = r"(?i)full.time|part.time|posts?|positions?|\d+\s*posts?|several|multiple|various"
SITS_UNDER = r"sits under (?:the\s+)?([A-Z][^,.]{3,60}?)(?:\s+at our|\s+campus|,|\.|$)"
DEPT_WORD = r"(?i)\b(School|Department|Office|Centre|Center|Graduate|Faculty|Institute|Registry|Library)\b"
DEPT_CELL = r"(?i)Faculty|Department|School|Institute|Centre|Office|Library"
DEPT_LINE = r"(?i)^(Department|Faculty|School|Academy|Division|Office|Centre|Center)"

# Titles of one source that are left out.
ADMIN_TITLES = (
    "administrative assistant", "clerical assistant", "finance officer", "it officer", "facilities manager",
    "procurement officer", "human resources officer", "security officer", "safety officer", "receptionist",
    "estate manager", "accounting officer", "payroll officer",
)

# What tells placeholders, protected pages, navigation and noise lines.
PLACEHOLDER, SEE_LINK = "Please visit the application link", "See application link"
BOT_MARKERS = ("security check", "not a bot", "verify that you are", "cloudflare")
NAV_LINE = r"(?i)^(Next|Previous|Go to page|Search|Filter|Home|Menu|\d+)$"
NOISE_LINES = ("n/a", "na", "reset", "search", "filter", "apply", "clear", "go", "next", "previous")

# Days after closing that a posting is kept, and lengths of descriptions.
RETENTION_DAYS, GOOD_CACHED, LONGEST_SUMMARY, LEAST_TO_SUMMARISE, LONGEST, LINE = 14, 80, 800, 300, 3000, 60

# Where links of each source start.
BASES = {
    "polyu": "https://jobs.polyu.edu.hk",
    "lingnan": "https://lingnan.csod.com",
    "hku": "https://jobs.hku.hk",
    "hkust": "https://hrmsxprod.psft.ust.hk:8044/psp/hrmsxprod/EMPLOYEE/HRMS/c/HRS_HRAM.HRS_CE.GBL?Page=HRS_CE_JOB_DTL&Action=A&JobOpeningId={ref}&SiteId=1000&PostingSeq=1",
    "cityu": "https://www.cityu.edu.hk",
    "hkbu": "https://fa-ewqq-saasfaprod1.fa.ocs.oraclecloud.com/hcmUI/CandidateExperience/en/sites/hkbu/job",
    "cuhk": "https://cuhk.taleo.net",
    "hkmu": "https://hkmu.taleo.net",
    "hksyu": "https://www.hksyu.edu",
}

# Patterns of a closing date on the detail pages of some sources, and the class of one's content.
CLOSING = {"hkbu": r"[Cc]losing\s+[Dd]ate[:\s]+(\d{1,2}\s+\w+\s+\d{4})", "cuhk": r"[Cc]losing\s+[Dd]ate[:\s]+(\w+\s+\d{1,2},\s+\d{4})", "hsu": r"(?i)(?:on or before|by|before)\s+(\d{1,2}\s+\w+\s+202\d)"}
CONTENT_CLASS = "ITS_Content_RichTextEditor"

# Patterns of fields in texts and links, by source.
AD_LABEL, AD_REF, AD_CLOSE = "Ad Date:", r"Ref:\s*(\d{6,})", r"Close Date[:\s]+([A-Za-z0-9 ]+)"
JOB_LABEL, LABEL_LINE, JOB_STOP, JOB_CLOSE = r"Job ID: (\d+)", r"\(\d+\)$", r"^(Open Date|Apply by|\d{4}-\d{2})", r"Apply by: ([\d\-]+)"
ACCORDION_CLOSE = r"Deadline\s*[\n\r]+\s*(\d{1,2}\s+\w+\s+202\d)"
SHORT_NUMBER, LONG_NUMBER = r"^\d{5,8}$", r"^\d{7,10}$"

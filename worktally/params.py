"""Business parameters. Results depend on them, so they are stated once, here."""

# Hours and overtime
DAILY_LIMIT = 8
WEEKLY_LIMIT = 40
MAX_DAILY_HOURS = 16
MAX_PLAUSIBLE_HOURS = 24
HOURS_TOLERANCE = 0.1
AMPM_DOUBT_HOURS = 14
OVERTIME_FACTOR = 1.5
TOTAL_TOLERANCE = 0.25
MAX_MONTH_HOURS = 744
LAB_MAX_PUNCH_HOURS = 16

# Matching
AUTO_MATCH = 0.85
REVIEW_MATCH = 0.60
SENDER_MATCH = 0.80
PARTIAL_WEIGHT = 0.9

# Normalising
MIN_ENTRIES = 1
MIN_DATED_RATIO = 0.5
MIN_HOURS_RATIO = 0.3
MIN_CONFIDENCE = 0.6
MULTISHEET_SPAN_DAYS = 65
OUTLIER_DAYS = 35
HEADER_SEARCH_ROWS = 15
BLOCK_LINES = 60
MIN_TEXT_CHARS = 80
MIN_PAGE_CHARS = 30
PAGE_MAJORITY = 0.7
COMPLETE_RATIO = 0.7

# Archives
MAX_ARCHIVE_MEMBERS = 5000
MAX_ARCHIVE_BYTES = 5000 * 1024 * 1024

# Activity
INACTIVE_MONTHS = 2

# Messages
SUBJECT_SCORE, BODY_SCORE, ATTACHMENT_SCORE = 0.50, 0.25, 0.30
VETO_CONFIDENCE, NO_ATTACHMENT_CONFIDENCE = 0.95, 0.70
MESSAGE_THRESHOLD, DECISIVE_CONFIDENCE, MODEL_OVERRIDE = 0.40, 0.80, 0.70

# --- fixed word lists -------------------------------------------------------------------------
NOISE_NAMES = ["desktop.ini", "thumbs.db", ".ds_store", ".gitkeep", "__macosx"]
BLOCKED_EXTENSIONS = [".exe", ".bat", ".sh", ".cmd", ".ps1", ".vbs", ".js", ".py", ".rb", ".pl",
                      ".php", ".dll", ".so", ".bin"]
SUPPORTED_EXTENSIONS = [".xlsx", ".xls", ".csv", ".docx", ".pdf", ".png", ".jpg", ".jpeg",
                        ".tiff", ".tif"]
ATTACHMENT_EXTENSIONS = [".pdf", ".xlsx", ".xls", ".docx", ".doc", ".png", ".jpg", ".jpeg", ".tiff"]
ATTACHMENT_MIMES = [
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.ms-excel",
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "image/png", "image/jpeg", "image/tiff",
]
# Company words that occur in file names but are no person names; a deployment adds its own here.
COMPANY_STOPWORDS = ["reimburs", "reimbursement", "staffing", "consulting", "services",
                     "solutions", "inc", "llc", "ltd", "corp", "group"]
LEAVE_TOKENS = ["leave", "sick", "vacation", "pto", "al", "sl", "pl", "cl", "ml", "el", "fl",
                "wfh", "holiday", "ph", "comp", "compensatory", "bereavement", "jury",
                "furlough", "absent", "lop"]
MONTHS_LONG = ["january", "february", "march", "april", "may", "june", "july", "august",
               "september", "october", "november", "december"]
MONTHS_SHORT = [m[:3] for m in MONTHS_LONG]
FILE_SUFFIX_WORDS = ["pdf", "csv", "xlsx", "docx", "doc", "xls"]
MATCH_NOISE_WORDS = (["ts", "timesheet", "timesheets", "time", "sheet", "record", "monthly",
                      "weekly", "daily", "bi", "bimonthly"]
                     + MONTHS_LONG + [m for m in MONTHS_SHORT if m != "may"]
                     + FILE_SUFFIX_WORDS + COMPANY_STOPWORDS)
NAME_NOISE_WORDS = (["week", "start", "end", "ending", "starting", "record", "time", "sheet",
                     "monthly", "weekly", "daily", "timesheet", "bi", "bimonthly", "semi",
                     "in", "out", "hrs", "hours", "regular", "total", "billable",
                     "classification", "overtime", "date", "period", "payroll", "ts"]
                    + [m for m in MONTHS_SHORT + MONTHS_LONG if m != "may"]
                    + FILE_SUFFIX_WORDS + COMPANY_STOPWORDS)
REJECTED_NAMES = ["monthly time record", "weekly time record", "daily time record", "time sheet",
                  "time record", "regular hours", "total hours", "employee name",
                  "employee signature", "prepared by"]
STREET_WORDS = ["court", "ave", "blvd", "street", "drive", "road", "lane", "place", "circle",
                "way", "boulevard", "parkway"]
HEADER_KEYWORDS = ["date", "day", "in", "out", "hours", "regular", "overtime", "leave", "holiday",
                   "total", "time", "clock", "worked", "sick", "vacation", "billable", "daily",
                   "non-billable", "hrs", "start", "end", "punch"]
BREAK_KEYWORDS = ["break", "lunch", "minus", "deduct", "unpaid"]
EMPTY_TOKENS = ["", "none", "nan", "nat", "null"]
# two-digit years from here on are years of the last century
CENTURY_PIVOT = 76
ADMIN_RULES = ["TWO_MONTH_INACTIVE"]
REGENERATED_RULES = ["EMPLOYEE_NOT_MATCHED", "EXTRACTION_FAILED", "NON_TIMESHEET_DOCUMENT",
                     "DAILY_HOURS_EXCEED", "DAILY_REGULAR_LIMIT_EXCEEDED", "WEEKLY_HOURS_EXCEED",
                     "HOURS_TOTAL_MISMATCH", "MISSING_APPROVAL", "MISSING_RATE",
                     "LATE_SUBMISSION", "HOLIDAY_WORK", "MISSING_TIMESHEET", "TWO_MONTH_INACTIVE"]
SEVERITIES = ["BLOCKER", "ERROR", "WARNING", "INFO"]

# fixed values: words that show a header cell is no person's name
NOT_A_PERSON = ["court", "ave", "blvd", "street", "drive", "road", "lane", "place", "circle", "way", "boulevard", "parkway",
                "timesheets", "timesheet", "gmail", "yahoo", "hotmail", "phone", "week ending", "month starting", "month ending",
                "client", "manager", "supervisor", "approver"]

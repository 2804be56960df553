"""Text patterns. What counts as a date, label, total or keyword decides results.

Case is folded with ``(?i)``; word edges are ``\\b`` on ASCII words.
"""

MONTH = ("jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?"
         "|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?")
MON3 = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
NUMBER = r"(\d{1,2}(?:\.\d{1,2})?)"
CLOCK = r"(\d{1,2}:\d{2}(?:\s*[AaPp][Mm])?)"

# file paths
PATH_PERIOD = rf"(?i)((?:{MON3})[_\-\s]?\d{{4}}|\d{{4}}[_\-]\d{{2}})"
TRAILING_NAME = r"\b([A-Z][A-Za-z\-']+\s+[A-Z][A-Za-z\-']+)\s*$"
PATH_DATE_WORDS = rf"(?i)\b(?:{MONTH})\b|\b\d{{4}}\b|\b\d{{1,2}}\b"
PATH_DOC_WORDS = r"(?i)\b(?:timesheets?|monthly|weekly|record|hours?|submission)\b"

# document type
DOC_YES = (r"(?i)\b(?:hours?|time\s*sheet|work\s*date|in\s*time|out\s*time|clock\s*in|clock\s*out|regular"
           rf"|overtime|employee|approved|(?:{MON3})\w+\s+20\d{{2}})\b")
DOC_NO = (r"(?i)\b(?:invoice|reimburs|receipt|purchase\s*order|statement|check\s*number|amount\s*due"
          r"|payment\s*terms)\b")
SCORE_DATES = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
HAS_SHEET_SIGNS = r"(?i)\d{1,2}:\d{2}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|\bhours?\b|\bhrs?\b"

# source lines
LINE_DATE = (rf"(?i)\b(?:\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{4}}-\d{{1,2}}-\d{{1,2}}"
             rf"|\d{{1,2}}-(?:{MON3})-\d{{2,4}}|(?:{MON3})\s+\d{{1,2}}(?:\s*,\s*\d{{4}})?"
             rf"|\d{{1,2}}\s+(?:{MON3})\s+\d{{2,4}})\b")
LINE_WEEKDAY = (r"(?i)\b(?:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?"
                r"|sat(?:urday)?|sun(?:day)?)\b")
LINE_TIME = r"(?i)\b\d{1,2}:\d{2}\s*(?:am|pm)?\b"
LINE_NUMBER = r"\b\d+(?:\.\d+)?\b"
SECTION = (r"(?i)week\s+(?:of|ending|starting|commencing)?\s*\d|w[/.]?e\.?\s+\d|week\s+\d+\b"
           r"|(?:weekly|monthly)\s+summary|period\s+\d{1,2}[/-]\d{1,2}")
PAGE_BREAK = r"(?i)---\s*page\s*break\s*---|={5,}|-{5,}|\f"
ROW_DATE = (r"(?i)(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}"
            rf"|\d{{1,2}}-(?:{MON3})-\d{{4}})")
ROW_HOURS = r"(?i)\b(\d+\.?\d*)\s*(?:hrs?|hours?)\b"
ROW_CLOCK = r"\b(\d{1,2}:\d{2}(?:\s*[AaPp][Mm])?)\b"

# filled-in sheets: labels end at two spaces, at the next label, or at the line end
_STOP = r"(?=\s{2,}|[A-Z][a-z]+\s*[:\-–]|\n|$)"
LABELS = {
    "employee_name": rf"(?i)(?:employee(?:\s*\w*)?|name|staff|worker|associate)\s*[:\-–]\s*([A-Za-z][A-Za-z '\.\-]+?){_STOP}",
    "employee_code": r"(?i)(?:employee\s*id|staff\s*id|id|badge|payroll\s*no?\.?)\s*[:\-–#]\s*([A-Z0-9\-/]{2,20})",
    "department": rf"(?i)(?:department|dept\.?|division|team)\s*[:\-–]\s*([A-Za-z][A-Za-z0-9\s\-&]+?){_STOP}",
    "manager": rf"(?i)(?:manager|supervisor|approver|approved\s+by)\s*[:\-–]\s*([A-Za-z][A-Za-z '\.\-]+?){_STOP}",
    "company": rf"(?i)(?:company|organisation|organization|employer)\s*[:\-–]\s*([A-Za-z][A-Za-z0-9\s\-&\.]+?){_STOP}",
}
APPROVAL_WORD = r"(?i)\b(approved|pending\s+approval|pending|rejected|submitted|draft|authorized)\b"
TOTAL = rf"(?i)\b(?:total|grand\s+total|total\s+hours?|hours?\s+total)\s*[:\-–]?\s*{NUMBER}"
APPROVED_TOTAL = rf"(?i)\b(?:approved\s+(?:total\s+)?hours?|hours?\s+approved|approved\s+total)\s*[:\-–]?\s*{NUMBER}"
SUBMITTED_TOTAL = rf"(?i)\b(?:submitted\s+(?:total\s+)?hours?|hours?\s+submitted)\s*[:\-–]?\s*{NUMBER}"
_D = r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"
PERIOD_RANGE = rf"(?i)\b(?:period|pay\s*period|week|fortnight|month)\s*[:\-–]?\s*{_D}\s*(?:to|[-–—])\s*{_D}"
DATE_RANGE = rf"{_D}\s*(?:to|[-–—])\s*{_D}"
MONTH_YEAR = rf"(?i)\b({MONTH})\s+(\d{{4}})\b"
WEEK_YEAR = r"(?i)\bweek\s*(\d{1,2})[,\s]+(\d{4})\b"
ROW_STRIPS = [r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}", CLOCK,
              r"\b\d{1,2}[-/]\d{1,2}\b"]

# names in text
TEXT_LABEL = (r"(?i)(?:employee|name|staff|worker|prepared\s*by|consultant|contractor|submitted\s*by"
              r"|timesheet\s*for|for\s*employee)[:\s]+([A-Za-z][A-Za-z\-' ]{2,})")
TEXT_SIGNATURE = r"(?i)([A-Za-z][A-Za-z\-' ]{2,})\s*\|?\s*Employee\s+(?:signature|sign)"
HEADER_LABEL = (r"(?i)(?:employee|name|staff|worker|consultant|contractor|prepared\s*by)"
                r"[:\s]+([A-Za-z][A-Za-z\-' ]{2,})")
HEADER_NAME = r"^([A-Z][A-Za-z\-']{1,}\s+[A-Z][A-Za-z\-']{1,}(?:\s+[A-Z][A-Za-z\-']{1,})?)$"
NOT_A_NAME_CELL = r"[@\d/\-:]"
PROPER_RUN = r"([A-Z][A-Za-z\-']{1,}(?:\s+[A-Z][A-Za-z\-']{1,})+)"

# messages
SUBJECT_YES = (r"(?i)\btimesheet\b|\btime\s*sheet\b|\btime\s*record\b|\bhours?\s*submission\b"
               r"|\bhours?\s*report\b|\bweekly\s*hours?\b|\bmonthly\s*hours?\b|\bwork\s*log\b"
               r"|\battendance\b|\bts\s+(?:for|submission|apr|may|jan|feb|mar|jun|jul|aug|sep|oct|nov|dec)\b"
               r"|\bts[-_\s]?\d{4}\b|\bplease\s+find.*(?:timesheet|hours)\b|\bsubmitting.*(?:timesheet|hours)\b")
BODY_YES = (r"(?i)\btimesheet\b|\btime\s*sheet\b|\bhours?\s+for\b|\bplease\s+(find|see|review)\b"
            r"|\bkindly\s+(find|approve)\b|\battached.*(?:timesheet|hours)\b|\bpayroll\s+period\b"
            r"|\bbilling\s+period\b")
SUBJECT_NO = (r"(?i)\binvoice\b|\breceipt\b|\bquotation\b|\bproposal\b|\bmeeting\b|\bcalendar\b"
              r"|\binterview\b|\bunsubscribe\b|\bnewsletter\b|\bpromotion\b|\bpurchase\s+order\b"
              r"|\bstatement\b")

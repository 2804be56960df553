"""Derived views over the given tables, as SQL text both engines run.

``{name}`` marks a table or another view. ``CHECK_VIEWS`` are used by check queries only: they
state intermediate results in plain SQL, independently of the DataFrame operators.
"""

VIEWS = {
    # one row per shift
    "fx_entry": """
SELECT e.*,
  CAST((in_min + CAST(FLOOR(entered_hours * 60) AS INT) + break_minutes
        + CASE WHEN entry_id % 7 = 0 THEN 30 ELSE 0 END) % 1440 AS INT) AS out_min,
  employee_id * 10 + CASE WHEN EXTRACT(DAY FROM work_date) <= 15 THEN 1 ELSE 2 END AS submission_id
FROM (SELECT event_id AS entry_id, user_id AS employee_id, CAST(ts AS DATE) AS work_date,
        CAST(EXTRACT(HOUR FROM ts) AS INT) * 60 + CAST(EXTRACT(MINUTE FROM ts) AS INT) AS in_min,
        CAST(CAST(value AS DECIMAL(10,2)) % 14 AS DECIMAL(5,2)) AS entered_hours,
        CASE event_type WHEN 'error' THEN 'LEAVE' WHEN 'signup' THEN 'HOLIDAY' ELSE 'WORK' END
          AS entry_type,
        CAST(event_id % 4 AS INT) * 15 AS break_minutes
      FROM {events}) e""",
    "fx_employee": """
SELECT c_custkey AS employee_id, c_nationkey AS vendor_id, c_acctbal >= 0 AS is_active,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'INTERNAL' WHEN 'MACHINERY' THEN 'CLIENT_VENDOR'
    ELSE 'CONTRACTOR' END AS employee_type,
  CONCAT('p', CAST(c_custkey AS VARCHAR(20)), '@mail.test') AS email
FROM {customer}""",
    "fx_person": """
SELECT c_custkey AS employee_id,
  CONCAT(split_part('Ana,Boris,Chloe,Dmitri,Elena,Farid,Greta,Hugo', ',',
                    CAST(c_custkey % 8 AS INT) + 1), ' ',
         split_part('Lopez,Smith,Okafor,Ito,Novak,Weber,Costa', ',',
                    CAST(FLOOR(c_custkey / 8) AS INT) % 7 + 1),
         CASE WHEN c_custkey >= 56 THEN CONCAT(' ', CAST(c_custkey AS VARCHAR(20))) ELSE '' END)
    AS full_name
FROM {customer}""",
    "fx_vendor": """
SELECT n_nationkey AS vendor_id, n_name AS name, n_regionkey < 3 AS overtime_enabled,
  CAST(8 AS DECIMAL(5,2)) AS daily_limit, CAST(40 AS DECIMAL(6,2)) AS weekly_limit
FROM {nation}""",
    "fx_rate": """
SELECT c_custkey AS employee_id, CAST(20 + c_custkey % 10 AS DECIMAL(10,4)) AS regular_rate,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(30 + c_custkey % 10 AS DECIMAL(10,4)) END
    AS overtime_rate,
  DATE '2023-01-01' AS effective_start,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE DATE '2024-01-14' END AS effective_end
FROM {customer} WHERE c_custkey % 17 <> 0
UNION ALL
SELECT c_custkey, CAST(22 + c_custkey % 10 AS DECIMAL(10,4)),
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(33 + c_custkey % 10 AS DECIMAL(10,4)) END,
  DATE '2024-01-15', NULL
FROM {customer} WHERE c_custkey % 17 <> 0""",
    "fx_holiday": """
SELECT 1 AS calendar_id, CAST(NULL AS VARCHAR(20)) AS applies_to, DATE '2024-01-01' AS holiday_date,
  'New Year' AS holiday_name, CAST(8 AS DECIMAL(5,2)) AS paid_hours
UNION ALL SELECT 2, 'INTERNAL', DATE '2024-01-15', 'Founders Day', CAST(8 AS DECIMAL(5,2))
UNION ALL SELECT 2, 'INTERNAL', DATE '2024-01-01', 'Staff New Year', CAST(8 AS DECIMAL(5,2))
UNION ALL SELECT 3, 'CLIENT_VENDOR', DATE '2024-01-22', 'Client Day', CAST(4 AS DECIMAL(5,2))""",
    "fx_period": """
SELECT 1 AS period_id, DATE '2024-01-01' AS period_start, DATE '2024-01-15' AS period_end,
  DATE '2024-01-14' AS cutoff_date
UNION ALL SELECT 2, DATE '2024-01-16', DATE '2024-01-31', DATE '2024-01-29'""",
    "fx_submission": """
SELECT submission_id, MIN(employee_id) AS employee_id, MIN(work_date) AS start_date,
  MAX(work_date) AS end_date, MAX(ts) AS submitted_at, MAX(half) AS period_id,
  CASE WHEN MIN(employee_id) % 6 = 0 THEN NULL
       ELSE CONCAT('mgr', CAST(MIN(employee_id) % 9 AS VARCHAR(5))) END AS approver_name,
  CASE WHEN MIN(employee_id) % 12 = 0
       THEN CONCAT('boss', CAST(MIN(employee_id) % 9 AS VARCHAR(5)), '@mail.test')
       ELSE NULL END AS approver_email,
  CASE WHEN MIN(employee_id) % 4 = 0 THEN NULL ELSE MIN(employee_id) % 25 END AS vendor_id,
  CASE MIN(employee_id) % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'REJECTED' ELSE 'APPROVED' END
    AS approval_status
FROM (SELECT user_id * 10 + CASE WHEN EXTRACT(DAY FROM ts) <= 15 THEN 1 ELSE 2 END AS submission_id,
        user_id AS employee_id, CAST(ts AS DATE) AS work_date, ts,
        CASE WHEN EXTRACT(DAY FROM ts) <= 15 THEN 1 ELSE 2 END AS half FROM {events}) s
GROUP BY submission_id""",
    # multi-year variant
    "fx_order_sub": """
SELECT o_orderkey AS submission_id, o_custkey AS employee_id, CAST(o_orderdate AS DATE) AS end_date,
  o_orderdate AS submitted_at,
  CASE o_orderstatus WHEN 'P' THEN 'CANCELLED' WHEN 'F' THEN 'READY' ELSE 'NOT_READY' END
    AS payroll_status,
  CAST(o_orderkey % 40 AS INT) AS batch_id
FROM {orders}""",
    "fx_order_entry": """
SELECT l_orderkey AS submission_id, l_linenumber AS line_number, CAST(l_shipdate AS DATE) AS work_date,
  CAST(CAST(l_quantity AS DECIMAL(10,2)) % 12 AS DECIMAL(5,2)) AS entered_hours,
  CASE WHEN l_linestatus = 'O' THEN NULL
       ELSE CAST(CAST(l_quantity AS DECIMAL(10,2)) % 10 AS DECIMAL(5,2)) END AS calculated_hours,
  l_partkey, l_suppkey
FROM {lineitem}""",
    # claims with missing and zero figures
    "fx_claim": """
SELECT event_id AS entry_id, user_id AS employee_id, CAST(ts AS DATE) AS work_date,
  user_id * 10 + CASE WHEN EXTRACT(DAY FROM ts) <= 15 THEN 1 ELSE 2 END AS submission_id,
  CASE event_type WHEN 'error' THEN 'LEAVE' WHEN 'signup' THEN 'HOLIDAY' ELSE 'WORK' END AS entry_type,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'SICK' ELSE NULL END AS leave_type,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST(0 AS DECIMAL(5,2))
       ELSE CAST(CAST(value AS DECIMAL(10,2)) % 20 AS DECIMAL(5,2)) END AS calculated_hours,
  CASE WHEN event_id % 5 = 0 THEN NULL
       ELSE CAST(CAST(value AS DECIMAL(10,2)) % 19 AS DECIMAL(5,2)) END AS entered_hours,
  CASE WHEN event_id % 3 = 0 THEN CAST(0 AS DECIMAL(5,2)) ELSE CAST(6 AS DECIMAL(5,2)) END
    AS regular_hours,
  CASE WHEN event_id % 9 = 1 THEN CAST(2 AS DECIMAL(5,2)) ELSE CAST(0 AS DECIMAL(5,2)) END
    AS overtime_hours
FROM {events}""",
    # messy rows as an extractor emits them: all strings
    "fx_raw": """
SELECT event_id AS seq, user_id * 10 + CASE WHEN EXTRACT(DAY FROM ts) <= 15 THEN 1 ELSE 2 END
    AS file_id,
  CASE WHEN user_id % 8 = 7 THEN NULL ELSE user_id END AS employee_id,
  CAST(FLOOR(user_id / 50) AS INT) AS batch_id,
  CASE CAST(event_id % 11 AS INT)
    WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 'INVALID_1900-01-05' ELSE 'none' END
    WHEN 1 THEN CONCAT(CAST(EXTRACT(MONTH FROM ts) AS VARCHAR(2)), '/',
                       CAST(EXTRACT(DAY FROM ts) AS VARCHAR(2)), '/2024')
    WHEN 2 THEN CONCAT(lpad(CAST(EXTRACT(DAY FROM ts) AS VARCHAR(2)), 2, '0'), '-Jan-2024')
    WHEN 3 THEN CONCAT('January ', CAST(EXTRACT(DAY FROM ts) AS VARCHAR(2)), ', 2024')
    WHEN 4 THEN '2024-02-31'
    WHEN 5 THEN ''
    ELSE CAST(CAST(ts AS DATE) AS VARCHAR(10)) END AS raw_date,
  CASE WHEN event_id % 5 = 0 THEN NULL
       WHEN event_id % 5 = 1 THEN CONCAT(CAST(EXTRACT(HOUR FROM ts) % 12 + 1 AS VARCHAR(2)), ':',
            lpad(CAST(EXTRACT(MINUTE FROM ts) AS VARCHAR(2)), 2, '0'),
            CASE WHEN event_id % 2 = 0 THEN ' AM' ELSE ' pm' END)
       ELSE CONCAT(lpad(CAST(EXTRACT(HOUR FROM ts) AS VARCHAR(2)), 2, '0'), ':',
            lpad(CAST(EXTRACT(MINUTE FROM ts) AS VARCHAR(2)), 2, '0')) END AS in_text,
  CASE WHEN event_id % 9 = 0 THEN NULL
       ELSE CONCAT(lpad(CAST((EXTRACT(HOUR FROM ts) + CAST(FLOOR(value) AS INT) % 12) % 24
                             AS VARCHAR(2)), 2, '0'), ':30') END AS out_text,
  CASE WHEN event_id % 13 = 0 THEN ''
       ELSE CAST(CAST(CAST(value AS DECIMAL(10,2)) % 30 AS DECIMAL(5,2)) AS VARCHAR(10)) END
    AS hours_text,
  CASE CAST(event_id % 6 AS INT) WHEN 0 THEN '' WHEN 1 THEN '30' WHEN 2 THEN '30.0'
    WHEN 3 THEN 'abc' WHEN 4 THEN '0.5' ELSE '60 min' END AS break_text,
  CASE event_type WHEN 'error' THEN 'LEAVE' WHEN 'signup' THEN 'HOLIDAY' ELSE 'WORK' END
    AS entry_type,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'SICK' ELSE NULL END AS leave_type
FROM {events}""",
    "fx_line": """
SELECT user_id AS doc_id, event_id AS line_no,
  CASE CAST(event_id % 12 AS INT) WHEN 0 THEN ''
    WHEN 1 THEN CASE WHEN user_id % 3 = 2 THEN 'carried over' ELSE 'Week 3' END
    WHEN 2 THEN CASE WHEN user_id % 3 = 0 THEN '=====' ELSE 'Mon 8' END
    WHEN 3 THEN 'Total hours: 40'
    ELSE CONCAT(CAST(CAST(ts AS DATE) AS VARCHAR(10)), ' ',
       lpad(CAST(EXTRACT(HOUR FROM ts) AS VARCHAR(2)), 2, '0'), ':',
       lpad(CAST(EXTRACT(MINUTE FROM ts) AS VARCHAR(2)), 2, '0'), ' ',
       CAST(CAST(CAST(value AS DECIMAL(10,2)) % 14 AS DECIMAL(5,2)) AS VARCHAR(10)), ' hrs') END
    AS line
FROM {events}""",
    # lines of filled-in sheets: labels, totals, rows in several layouts
    "fx_form": """
SELECT user_id AS doc_id, event_id AS line_no,
  CASE CAST(event_id % 16 AS INT)
    WHEN 0 THEN CONCAT('Employee: ', split_part('Ana Lopez,Boris Smith,Chloe Ito', ',',
                       CAST(event_id % 3 AS INT) + 1))
    WHEN 1 THEN CONCAT('Employee ID: E-', CAST(event_id % 100 AS VARCHAR(5)))
    WHEN 2 THEN 'Department: Field Ops   Manager: Greta Costa'
    WHEN 3 THEN CONCAT('Company: Acme', CAST(event_id % 4 AS VARCHAR(2)))
    WHEN 4 THEN CASE WHEN event_id % 3 = 0 THEN 'Status: Approved' ELSE 'status pending' END
    WHEN 5 THEN CONCAT('Total hours: ', CAST(CAST(CAST(value AS DECIMAL(10,2)) % 60 AS DECIMAL(5,1))
                       AS VARCHAR(8)))
    WHEN 6 THEN CONCAT('Approved hours: ', CAST(event_id % 50 AS VARCHAR(5)))
    WHEN 7 THEN CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'Period: 01/01/2024 to 15/01/2024'
                  WHEN 1 THEN 'Sheet for January 2024' ELSE 'Week 2, 2024' END
    WHEN 8 THEN CONCAT('Mon ', CAST(CAST(ts AS DATE) AS VARCHAR(10)), ' 09:00 17:30 8.0 PROJ task')
    WHEN 9 THEN CONCAT(CAST(EXTRACT(DAY FROM ts) AS VARCHAR(2)), '/01/2024 ',
                       CAST(event_id % 9 AS VARCHAR(2)), ' 1.5')
    WHEN 10 THEN CONCAT(CAST(EXTRACT(DAY FROM ts) AS VARCHAR(2)), ' January 2024 8 2 10')
    WHEN 11 THEN CONCAT('Jan ', CAST(EXTRACT(DAY FROM ts) AS VARCHAR(2)),
                        ', 2024 9:15 AM 5:45 PM visit')
    WHEN 12 THEN CONCAT('13/25/2024 ', CAST(event_id % 30 AS VARCHAR(2)))
    WHEN 13 THEN 'Ana Novak | Employee signature'
    WHEN 14 THEN CONCAT('01/', CAST(EXTRACT(DAY FROM ts) AS VARCHAR(2)), '/2024 ',
                        CAST(event_id % 40 AS VARCHAR(3)), ' hrs')
    ELSE 'notes only' END AS line
FROM {events}""",
    "fx_path": """
SELECT page_id AS file_id,
  CONCAT(split_part('Acme,Globex,Initech', ',', CAST(page_id % 3 AS INT) + 1), '/',
    split_part(CONCAT('Ana_Lopez_April_2024.xlsx|thumbs.db|run.exe|notes.txt|Boris Smith 2024-01.pdf',
                      '|image.png|Timesheets Jan 2024 Chloe Okafor.csv|LLC_ITO_HUGO_2023.docx',
                      '|README|week 12-5 Elena.pdf|DMITRI NOVAK Feb_2024.xls'), '|',
               CAST(page_id % 11 AS INT) + 1)) AS rel_path,
  CAST(length(html) AS BIGINT) AS size_bytes, html
FROM {pages}""",
    "fx_kw": """
SELECT doc_id,
  CONCAT(split_part(CONCAT('timesheet hours overtime employee|invoice receipt amount due',
                           '|employee hours invoice statement|hours|nothing here'), '|',
                    CAST(doc_id % 5 AS INT) + 1), ' ', text) AS text
FROM {documents}""",
    "fx_file": """
SELECT doc_id AS file_id, CAST(FLOOR(doc_id / 40) AS INT) AS batch_id, source AS folder_path,
  CONCAT(split_part('=sum,Ana Lopez ,report,@cmd,-x', ',', CAST(doc_id % 5 AS INT) + 1),
         CAST(doc_id AS VARCHAR(20)), '.xlsx') AS file_name,
  '.xlsx' AS file_ext, n_chars AS size_bytes, text,
  split_part(CONCAT('COMPLETED,FAILED,NEEDS_REVIEW,NORMALIZED,MATCHED,EXTRACTION_FAILED,',
                    'NON_TIMESHEET_DOCUMENT,UNSUPPORTED_FILE_TYPE,DETECTED'), ',',
             CAST((doc_id + FLOOR(doc_id / 40)) % 9 AS INT) + 1) AS processing_status,
  doc_id % 13 = 0 AS is_noise, doc_id % 17 = 0 AS is_duplicate, doc_id % 19 <> 0 AS is_candidate,
  doc_id % 4 = 0 AS ocr_required,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 150 END AS matched_employee_id,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST((doc_id % 41 + 60) AS DECIMAL(5,2)) END
    AS match_percent,
  CASE WHEN doc_id % 3 = 0 THEN 'NOT_MATCHED' WHEN doc_id % 41 < 25 THEN 'NEEDS_REVIEW'
       ELSE 'AUTO_MATCHED' END AS match_status,
  CASE WHEN doc_id % 7 = 0 THEN NULL
       ELSE split_part('Ana Lopez,-Boris,Chloe Ito', ',', CAST(doc_id % 3 AS INT) + 1) END
    AS detected_name,
  CAST(doc_id % 6 AS INT) AS entry_count,
  CASE WHEN doc_id % 10 = 9 THEN NULL ELSE CAST(doc_id % 101 AS DECIMAL(5,2)) END
    AS extraction_percent,
  'csv' AS extraction_method
FROM {documents}""",
    "fx_member": """
SELECT CAST(FLOOR(doc_id / 50) AS BIGINT) AS archive_id, doc_id AS pos,
  CONCAT(CASE WHEN doc_id % 23 = 0 THEN '../../' WHEN doc_id % 29 = 0 THEN '/abs/' ELSE 'a/' END,
         CASE WHEN doc_id % 31 = 0 THEN 'x/../' ELSE '' END, CAST(doc_id AS VARCHAR(20)),
         CASE WHEN doc_id % 11 = 0 THEN '.exe' ELSE '.csv' END) AS member,
  n_chars AS size_bytes
FROM {documents}""",
    "fx_message": """
SELECT CONCAT(CAST(conv_id AS VARCHAR(20)), '-', CAST(turn AS VARCHAR(20))) AS message_id,
  conv_id AS job_id, turn,
  split_part(CONCAT('Timesheet for January|Invoice 77|Weekly hours|Lunch?|Newsletter',
                    '|TS 2024 attached'), '|', CAST((conv_id + turn) % 6 AS INT) + 1) AS subject,
  CONCAT(CASE WHEN conv_id % 4 = 1 THEN 'Please find attached. ' ELSE '' END, text) AS body,
  CASE WHEN conv_id % 3 = 0 THEN NULL
       WHEN conv_id % 3 = 1 THEN 'sheet.xlsx' ELSE 'logo.GIF' END AS attachment_name,
  CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 6 = 2 THEN 'application/pdf'
       ELSE 'image/gif' END AS attachment_mime,
  CASE WHEN turn % 2 = 0 THEN CONCAT('Person ', CAST(conv_id AS VARCHAR(10)), ' <P',
                                     CAST(conv_id AS VARCHAR(10)), '@Mail.Test>')
       ELSE CONCAT('P', CAST(conv_id AS VARCHAR(10)), '@Mail.Test') END AS sender,
  CAST(1 + (conv_id * 7 + turn) % 28 AS INT) AS received_day,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'PENDING_APPROVAL'
    WHEN 2 THEN 'SKIPPED' ELSE 'NEW' END AS stored_status,
  role
FROM {conversations}""",
    # text cells with pipe tables between prose
    "fx_table_text": """
SELECT doc_id, CONCAT('intro', chr(10), '| date | hours |', chr(10), '|------|:-----:|', chr(10),
  '| 2024-01-0', CAST(doc_id % 9 + 1 AS VARCHAR(2)), ' | ', CAST(n_chars AS VARCHAR(10)), ' |', chr(10),
  CASE WHEN doc_id % 2 = 0 THEN CONCAT('|| 2024-02-01 | 8 ||', chr(10)) ELSE '' END,
  replace(text, '|', '/'), chr(10), '| alone | row |', chr(10), 'middle', chr(10),
  CASE WHEN doc_id % 3 = 0 THEN CONCAT(' | a | b | c |', chr(10), '| 1 |  | 3 |') ELSE '| no' END) AS text
FROM {documents}""",
    "fx_engine": """
SELECT doc_id, 0 AS engine_rank, 'ocr' AS engine, text, CAST(0 AS INT) AS table_rows,
  CAST(doc_id % 100 AS DECIMAL(5,2)) AS confidence_pct FROM {documents}
UNION ALL SELECT doc_id, 1, 'ocr_vlm', CASE WHEN doc_id % 4 = 0 THEN '' ELSE CONCAT(text, ' 2024-01-05') END,
  CAST(doc_id % 5 AS INT), CAST(90 AS DECIMAL(5,2)) FROM {documents}
UNION ALL SELECT doc_id, 2, 'vlm', CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE CONCAT(text, ' 2024-01-05') END,
  CAST(doc_id % 5 AS INT), CAST(90 AS DECIMAL(5,2)) FROM {documents}""",
    "fx_page_fact": """
SELECT CAST(FLOOR(doc_id / 10) AS BIGINT) AS doc_id, doc_id % 10 AS page_no,
  CASE WHEN FLOOR(doc_id / 10) % 4 = 0 THEN n_chars
       WHEN FLOOR(doc_id / 10) % 4 = 1 THEN 0
       WHEN FLOOR(doc_id / 10) % 4 = 2 AND doc_id % 10 < 3 THEN 5
       WHEN FLOOR(doc_id / 10) % 4 = 3 AND doc_id % 10 < 5 THEN 12 ELSE n_chars END AS text_chars
FROM {documents}""",
    "fx_json": """
SELECT event_id, CASE CAST(event_id % 10 AS INT) WHEN 0 THEN '{{bad' WHEN 1 THEN '{{"k": ""}}'
  WHEN 2 THEN '{{"k": "12.5", "zz": 1}}' WHEN 3 THEN '{{"k": "abc"}}' WHEN 4 THEN '{{"zz": 2}}'
  ELSE props END AS js FROM {events}""",
    "fx_sheet": """
SELECT user_id AS file_id, CASE WHEN user_id % 5 = 1 THEN 1 ELSE CAST(event_id % 3 AS INT) END AS sheet_no, event_id AS seq,
  CAST(ts AS DATE) + CASE WHEN user_id % 5 <> 1 AND user_id % 4 = 0 AND event_id % 3 = 2 THEN 90 ELSE 0 END AS work_date
FROM {events}""",
    # grids of twenty rows; the header sits at a different row in each
    "fx_grid": """
SELECT g.*, CASE WHEN row_no < h THEN 'P' WHEN row_no = h THEN 'H' ELSE 'D' END AS part
FROM (SELECT CAST(FLOOR(event_id / 20) AS BIGINT) AS file_id, CAST(event_id % 20 AS INT) AS row_no,
  CAST(FLOOR(event_id / 20) AS INT) % 17 AS h, CAST(FLOOR(event_id / 20) AS INT) % 3 AS layout,
  CASE CAST(event_id % 7 AS INT) WHEN 1 THEN '1/9/2024' WHEN 2 THEN 'INVALID_1900-01-07' WHEN 3 THEN ''
    ELSE CAST(CAST(ts AS DATE) AS VARCHAR(10)) END AS d,
  CASE CAST(event_id % 5 AS INT) WHEN 0 THEN '-' WHEN 1 THEN '9:15 AM' WHEN 2 THEN '7:30' ELSE '09:00' END AS i,
  CASE CAST(event_id % 4 AS INT) WHEN 0 THEN '0:00' WHEN 1 THEN '5:45 pm' WHEN 2 THEN 'late' ELSE '17:30' END AS o,
  CASE CAST(event_id % 3 AS INT) WHEN 0 THEN '0.5' WHEN 1 THEN '45 min' ELSE 'n/a' END AS b,
  CASE CAST(event_id % 8 AS INT) WHEN 0 THEN '0' WHEN 1 THEN 'none'
    ELSE CAST(CAST(CAST(value AS DECIMAL(10,2)) % 14 AS DECIMAL(5,2)) AS VARCHAR(10)) END AS w,
  CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'pto' WHEN 1 THEN 'Public holiday' WHEN 2 THEN 'ok' ELSE '' END AS l,
  CASE CAST(event_id % 6 AS INT) WHEN 0 THEN '8' WHEN 1 THEN '0' ELSE '' END AS s
FROM {events}) g""",
    "fx_name": """
SELECT employee_id, CASE CAST(employee_id % 12 AS INT)
  WHEN 0 THEN 'Susan Savage April' WHEN 1 THEN 'Savage, Susan' WHEN 2 THEN 'Richard TS'
  WHEN 3 THEN 'Monthly Time Record' WHEN 4 THEN 'Jane Doe Reimbursement'
  WHEN 5 THEN CONCAT(full_name, ' Week Start') WHEN 6 THEN UPPER(full_name)
  WHEN 7 THEN CONCAT('Timesheet 2024 ', full_name) WHEN 8 THEN 'total hours'
  WHEN 9 THEN CONCAT(' ', full_name, '  ') WHEN 10 THEN '' ELSE full_name END AS name
FROM {fx_person}""",
    "fx_people": """
SELECT p.employee_id, CASE WHEN p.employee_id % 20 = 7 THEN CONCAT('=', p.full_name) ELSE p.full_name END AS full_name,
  e.vendor_id, e.is_active, e.employee_type, e.email,
  CASE WHEN p.employee_id % 3 = 0 THEN NULL ELSE CONCAT('E', CAST(p.employee_id AS VARCHAR(20))) END AS employee_code
FROM {fx_person} p JOIN {fx_employee} e ON e.employee_id = p.employee_id""",
    "fx_batch": """
SELECT o_orderkey AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'PROCESSING'
  ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'NEEDS_REVIEW' ELSE 'PAYROLL_READY' END END AS status,
  o_orderdate AS created_at, o_totalprice AS size FROM {orders}""",
    "fx_approval": """
SELECT event_id, user_id * 10 + CASE WHEN user_id % 5 = 4 THEN 9 WHEN EXTRACT(DAY FROM ts) <= 15 THEN 1 ELSE 2 END AS submission_id,
  CASE event_type WHEN 'click' THEN 'APPROVED' WHEN 'view' THEN 'REJECTED' ELSE 'PENDING' END AS status,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE CONCAT('lead', CAST(event_id % 7 AS VARCHAR(3))) END AS name,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CONCAT('l', CAST(event_id % 7 AS VARCHAR(3)), '@mail.test') END AS email,
  ts AS decided_at FROM {events}""",
    # an existing table of findings (one per entry with a fault)
    "fx_finding": """
SELECT event_id AS finding_id, user_id * 10 + CASE WHEN EXTRACT(DAY FROM ts) <= 15 THEN 1 ELSE 2 END
    AS submission_id,
  user_id AS employee_id, CAST(FLOOR(user_id / 50) AS INT) AS batch_id, event_id % 1000 * 5 AS file_id,
  split_part('BLOCKER,ERROR,WARNING,INFO,WARNING', ',', CAST(event_id % 5 AS INT) + 1) AS severity,
  split_part(CONCAT('MISSING_RATE,INVALID_DATE,TWO_MONTH_INACTIVE,NON_TIMESHEET_DOCUMENT,',
                    'HOLIDAY_WORK,EMPLOYEE_NOT_MATCHED,EXTRACTION_FAILED'), ',',
             CAST(event_id % 7 AS INT) + 1) AS rule_code,
  CASE WHEN user_id % 5 <> 2 OR event_id % 3 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status,
  ts AS created_at
FROM {events}""",
    "fx_patch": """
SELECT event_id AS entry_id,
  CASE WHEN event_id % 2 = 0 THEN CAST(7.5 AS DECIMAL(5,2)) ELSE NULL END AS entered_hours,
  CASE WHEN event_id % 3 = 0 THEN 480 ELSE NULL END AS in_min,
  CASE WHEN event_id % 5 = 0 THEN 'LEAVE' ELSE NULL END AS entry_type
FROM {events} WHERE event_id % 6 < 2""",
}

CHECK_VIEWS = {
    "ck_hours": """
SELECT e.*, CASE WHEN raw > 14 AND entered_hours > 0 AND entered_hours <= 14 THEN entered_hours
                 ELSE raw END AS calculated_hours,
  CASE WHEN raw > 14 AND entered_hours > 0 AND entered_hours <= 14
       THEN 'ENTERED_HOURS_USED_AMPM_AMBIGUITY' ELSE 'CALCULATED_FROM_IN_OUT' END AS method
FROM (SELECT *, CAST(ROUND(CASE WHEN mins < 0 THEN 0 ELSE mins END / 60.0, 2) AS DECIMAL(10,2)) AS raw
      FROM (SELECT *, out_min + CASE WHEN out_min < in_min THEN 1440 ELSE 0 END - in_min
                      - break_minutes AS mins FROM fx_entry) a) e""",
    "ck_split": """
SELECT p.*, CASE WHEN payroll_hours <= daily_limit OR NOT ot_allowed THEN payroll_hours
                 ELSE daily_limit END AS regular_hours,
  CASE WHEN payroll_hours > daily_limit AND ot_allowed THEN payroll_hours - daily_limit
       ELSE 0 END AS overtime_hours
FROM (SELECT h.*, abs(h.entered_hours - calculated_hours) > 0.1 AS mismatch,
        CASE WHEN abs(h.entered_hours - calculated_hours) > 0.1 THEN h.entered_hours
             ELSE calculated_hours END AS payroll_hours,
        COALESCE(v.daily_limit, 8) AS daily_limit, COALESCE(v.weekly_limit, 40) AS weekly_limit,
        COALESCE(v.overtime_enabled, TRUE) AS ot_allowed, v.vendor_id, v.name AS vendor_name
      FROM ck_hours h LEFT JOIN fx_employee e ON e.employee_id = h.employee_id
      LEFT JOIN fx_vendor v ON v.vendor_id = e.vendor_id) p""",
    "ck_weekly": """
SELECT s.* EXCLUDE (regular_hours, overtime_hours), regular_hours - move AS regular_hours,
  overtime_hours + move AS overtime_hours, move
FROM (SELECT *, CASE WHEN NOT ot_allowed THEN 0
        ELSE GREATEST(0, LEAST(regular_hours, wk - weekly_limit - prev)) END AS move
      FROM (SELECT *, SUM(regular_hours) OVER (PARTITION BY submission_id, date_trunc('week', work_date)) AS wk,
              COALESCE(SUM(regular_hours) OVER (PARTITION BY submission_id, date_trunc('week', work_date)
                ORDER BY work_date DESC, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
            FROM ck_split) x) s""",
    "ck_totals": """
SELECT submission_id, SUM(regular_hours) AS regular_hours, SUM(overtime_hours) AS overtime_hours,
  COUNT(*) FILTER (entry_type = 'LEAVE') AS leave_days,
  COALESCE(SUM(calculated_hours) FILTER (entry_type = 'HOLIDAY'), 0) AS holiday_hours,
  COUNT(*) AS entries
FROM ck_weekly GROUP BY submission_id""",
    "ck_rated": """
SELECT s.*, r.regular_rate, r.overtime_rate, r.effective_start
FROM fx_submission s LEFT JOIN LATERAL (
  SELECT * FROM fx_rate r WHERE r.employee_id = s.employee_id AND r.effective_start <= s.end_date
    AND (r.effective_end IS NULL OR r.effective_end >= s.end_date)
  ORDER BY r.effective_start DESC LIMIT 1) r ON TRUE""",
    "ck_pay": """
SELECT r.submission_id, r.employee_id, t.regular_hours, t.overtime_hours, t.leave_days,
  t.holiday_hours, r.regular_rate,
  CASE WHEN r.overtime_rate IS NULL OR r.overtime_rate = 0 THEN r.regular_rate * 1.5
       ELSE r.overtime_rate END AS overtime_rate,
  CAST(t.regular_hours * r.regular_rate AS DECIMAL(18,4)) AS regular_pay,
  CAST(t.overtime_hours * CASE WHEN r.overtime_rate IS NULL OR r.overtime_rate = 0
       THEN r.regular_rate * 1.5 ELSE r.overtime_rate END AS DECIMAL(18,4)) AS overtime_pay,
  CASE WHEN r.regular_rate IS NULL THEN 'BLOCKED' ELSE 'READY' END AS payroll_status
FROM ck_rated r JOIN ck_totals t ON t.submission_id = r.submission_id
JOIN ck_sub k ON k.submission_id = r.submission_id AND k.validation_status = 'PASSED' AND k.payroll_status = 'READY'""",
    # the messy rows, typed; raw_date layouts are those of fx_raw
    "ck_typed": """
SELECT r.*, CASE WHEN employee_id IS NULL THEN CONCAT('f', file_id)
                 ELSE CONCAT('e', employee_id, '-b', batch_id) END AS submission_id,
  COALESCE(TRY_CAST(TRY_STRPTIME(raw_date, '%Y-%m-%d') AS DATE),
           CAST(TRY_STRPTIME(raw_date, '%m/%d/%Y') AS DATE),
           CAST(TRY_STRPTIME(raw_date, '%d-%b-%Y') AS DATE),
           CAST(TRY_STRPTIME(raw_date, '%B %d, %Y') AS DATE)) AS work_date,
  CASE WHEN in_text LIKE '%pm' THEN
         (CAST(split_part(in_text, ':', 1) AS INT) % 12 + 12) * 60 + CAST(substr(split_part(in_text, ':', 2), 1, 2) AS INT)
       WHEN in_text LIKE '%AM' THEN
         (CAST(split_part(in_text, ':', 1) AS INT) % 12) * 60 + CAST(substr(split_part(in_text, ':', 2), 1, 2) AS INT)
       ELSE CAST(split_part(in_text, ':', 1) AS INT) * 60 + CAST(split_part(in_text, ':', 2) AS INT) END AS in_min,
  CAST(split_part(out_text, ':', 1) AS INT) * 60 + CAST(split_part(out_text, ':', 2) AS INT) AS out_min,
  TRY_CAST(hours_text AS DECIMAL(10,2)) AS entered_hours,
  CAST(ROUND(COALESCE(TRY_CAST(break_text AS DOUBLE), 0)) AS INT) AS break_minutes
FROM fx_raw r""",
    "ck_timed": """
SELECT *, GREATEST(COALESCE(entered_hours, 0), COALESCE(calculated_hours, 0)) > 24 AS implausible
FROM (SELECT *, CASE WHEN raw > 14 AND entered_hours > 0 AND entered_hours <= 14 THEN entered_hours
                     WHEN raw IS NOT NULL THEN raw ELSE entered_hours END AS calculated_hours
      FROM (SELECT *, CAST(ROUND(GREATEST(out_min + CASE WHEN out_min < in_min THEN 1440 ELSE 0 END - in_min
                      - break_minutes, 0) / 60.0, 2) AS DECIMAL(10,2))
                      * CASE WHEN in_min IS NULL OR out_min IS NULL THEN NULL ELSE 1 END AS raw
            FROM ck_typed) a) b""",
    "ck_built": """
SELECT t.*, s.seed, s.s_in, s.s_out, s.s_calc, s.s_ent FROM ck_timed t LEFT JOIN (
  SELECT submission_id, work_date, MIN(seq) AS seed, arg_min(COALESCE(in_min, -1), seq) AS i0,
    NULLIF(arg_min(COALESCE(in_min, -1), seq), -1) AS s_in,
    NULLIF(arg_min(COALESCE(out_min, -1), seq), -1) AS s_out,
    arg_min(COALESCE(calculated_hours, 0), seq) AS s_calc, arg_min(COALESCE(entered_hours, 0), seq) AS s_ent
  FROM ck_timed WHERE work_date IS NOT NULL AND NOT implausible GROUP BY 1, 2) s
ON s.submission_id = t.submission_id AND s.work_date = t.work_date""",
    # built rows to stored entries: disposition, daily split, weekly overtime
    "ck_disposed": """
SELECT *, CASE WHEN work_date IS NULL THEN CASE WHEN raw_date LIKE 'INVALID%' THEN 'INVALID_DATE' ELSE 'NO_DATE' END
    WHEN seed IS NOT NULL AND seq > seed AND NOT COALESCE(in_min IS NOT NULL AND out_min IS NOT NULL
          AND s_in IS NOT NULL AND s_out IS NOT NULL AND (in_min <> s_in OR out_min <> s_out), FALSE)
      THEN CASE WHEN abs(COALESCE(NULLIF(s_calc, 0), s_ent, 0) - COALESCE(entered_hours, 0)) > 0.1
                THEN 'OVERLAPPING_DATE_CONFLICT' ELSE 'DUPLICATE_DATE' END
    WHEN implausible THEN 'IMPLAUSIBLE_HOURS' ELSE 'STORED' END AS disposition FROM ck_built""",
    "ck_stored": """
SELECT * REPLACE (regular_hours - move AS regular_hours, hours - regular_hours + move AS overtime_hours)
FROM (SELECT *, CASE WHEN NOT ot_allowed THEN 0 ELSE GREATEST(0, LEAST(regular_hours, wk - weekly_limit - prev)) END AS move
  FROM (SELECT *, hours - regular_hours AS overtime_hours, SUM(regular_hours) OVER w AS wk,
      COALESCE(SUM(regular_hours) OVER (PARTITION BY submission_id, date_trunc('week', work_date)
        ORDER BY work_date DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
    FROM (SELECT *, CASE WHEN ot_allowed THEN LEAST(hours, daily_limit) ELSE hours END AS regular_hours
      FROM (SELECT *, CASE WHEN mismatch THEN entered_hours ELSE calculated_hours END AS payroll_hours,
          COALESCE(CASE WHEN mismatch THEN entered_hours ELSE calculated_hours END, 0) AS hours
        FROM (SELECT d.*, v.vendor_id, COALESCE(v.daily_limit, 8) AS daily_limit, COALESCE(v.weekly_limit, 40) AS weekly_limit,
            v.overtime_enabled, COALESCE(v.overtime_enabled, TRUE) AS ot_allowed,
            COALESCE(in_min IS NOT NULL AND out_min IS NOT NULL AND abs(entered_hours - calculated_hours) > 0.1, FALSE) AS mismatch
          FROM ck_disposed d LEFT JOIN fx_employee e ON e.employee_id = d.employee_id LEFT JOIN fx_vendor v ON v.vendor_id = e.vendor_id
          WHERE disposition = 'STORED') a) b) c WINDOW w AS (PARTITION BY submission_id, date_trunc('week', work_date))) x) s""",
    "ck_store": """
SELECT d.seq, d.file_id, d.submission_id, d.work_date, d.disposition, e.vendor_id, d.entered_hours, d.calculated_hours,
  s.payroll_hours, s.regular_hours, s.overtime_hours, s.move AS moved_hours
FROM ck_disposed d LEFT JOIN fx_employee e ON e.employee_id = d.employee_id LEFT JOIN ck_stored s ON s.seq = d.seq""",
    "ck_store_finding": """
SELECT disposition AS rule_code, CASE disposition WHEN 'OVERLAPPING_DATE_CONFLICT' THEN 'BLOCKER' WHEN 'DUPLICATE_DATE' THEN 'WARNING'
    ELSE 'ERROR' END AS severity, CAST(file_id AS VARCHAR) AS file_id, submission_id, CAST(seq AS VARCHAR) AS entry_id,
  CAST(employee_id AS VARCHAR) AS employee_id,
  CASE WHEN disposition = 'OVERLAPPING_DATE_CONFLICT' THEN CAST(CAST(COALESCE(NULLIF(s_calc, 0), s_ent, 0) AS DECIMAL(10,2)) AS VARCHAR) END AS expected_value,
  CASE disposition WHEN 'INVALID_DATE' THEN raw_date WHEN 'DUPLICATE_DATE' THEN CAST(work_date AS VARCHAR)
    WHEN 'IMPLAUSIBLE_HOURS' THEN CAST(CAST(GREATEST(COALESCE(entered_hours, 0), COALESCE(calculated_hours, 0)) AS DECIMAL(10,2)) AS VARCHAR)
    ELSE CAST(CAST(COALESCE(entered_hours, 0) AS DECIMAL(10,2)) AS VARCHAR) END AS actual_value
FROM ck_disposed WHERE disposition NOT IN ('STORED', 'NO_DATE')
UNION ALL SELECT rule_code, severity, CAST(file_id AS VARCHAR), submission_id, CAST(seq AS VARCHAR), CAST(employee_id AS VARCHAR),
  CAST(CAST(expected AS DECIMAL(10,2)) AS VARCHAR), CAST(CAST(actual AS DECIMAL(10,2)) AS VARCHAR)
FROM (SELECT *, 'DAILY_REGULAR_LIMIT_EXCEEDED' AS rule_code, 'WARNING' AS severity, daily_limit AS expected, regular_hours AS actual
    FROM ck_stored WHERE regular_hours > daily_limit + 0.1
  UNION ALL SELECT *, 'HOURS_TOTAL_MISMATCH', 'ERROR', COALESCE(NULLIF(calculated_hours, 0), NULLIF(entered_hours, 0), 0), regular_hours + overtime_hours
    FROM ck_stored WHERE COALESCE(NULLIF(calculated_hours, 0), NULLIF(entered_hours, 0), 0) > 0
      AND abs(COALESCE(NULLIF(calculated_hours, 0), NULLIF(entered_hours, 0), 0) - regular_hours - overtime_hours) > 0.1
  UNION ALL SELECT *, 'DAILY_HOURS_MISMATCH', 'ERROR', calculated_hours, entered_hours FROM ck_stored WHERE mismatch
) q
UNION ALL SELECT 'DAILY_HOURS_EXCEED', 'ERROR', CAST(file_id AS VARCHAR), submission_id, CAST(seq AS VARCHAR), CAST(employee_id AS VARCHAR), '16',
  CAST(CAST(COALESCE(NULLIF(calculated_hours, 0), NULLIF(entered_hours, 0), 0) AS DECIMAL(10,2)) AS VARCHAR)
FROM ck_stored WHERE COALESCE(NULLIF(calculated_hours, 0), NULLIF(entered_hours, 0), 0) > 16
UNION ALL SELECT 'OVERTIME_NOT_ALLOWED', 'ERROR', CAST(file_id AS VARCHAR), submission_id, CAST(seq AS VARCHAR), CAST(employee_id AS VARCHAR), '0',
  CAST(CAST(payroll_hours - daily_limit AS DECIMAL(10,2)) AS VARCHAR) FROM ck_stored WHERE NOT overtime_enabled AND payroll_hours > daily_limit
UNION ALL SELECT 'WEEKLY_HOURS_EXCEED', CASE WHEN allowed THEN 'WARNING' ELSE 'ERROR' END, NULL, submission_id, NULL, CAST(employee_id AS VARCHAR),
  CAST(CAST(lim AS DECIMAL(10,2)) AS VARCHAR), CAST(CAST(total AS DECIMAL(20,2)) AS VARCHAR)
FROM (SELECT submission_id, employee_id, strftime(work_date, '%Y-W%W') AS week, MAX(weekly_limit) AS lim, BOOL_AND(ot_allowed) AS allowed,
    SUM(COALESCE(NULLIF(calculated_hours, 0), NULLIF(entered_hours, 0), 0)) AS total FROM ck_stored WHERE entry_type = 'WORK' GROUP BY ALL) w
WHERE total > lim""",
    "ck_holiday": """
SELECT c.*, employee_type, CASE WHEN entry_type = 'WORK'
    AND COALESCE(NULLIF(calculated_hours, 0), entered_hours, 0) > 0 THEN (
  SELECT arg_min(holiday_name, calendar_id) FROM fx_holiday h WHERE h.holiday_date = c.work_date
    AND (h.applies_to IS NULL OR h.applies_to = e.employee_type)) END AS holiday_name
FROM fx_claim c LEFT JOIN fx_employee e ON e.employee_id = c.employee_id""",
    "ck_holiday_scoped": """
SELECT c.*, employee_type, CASE WHEN entry_type = 'WORK'
    AND COALESCE(NULLIF(calculated_hours, 0), entered_hours, 0) > 0 THEN (
  SELECT arg_min(holiday_name, calendar_id) FROM fx_holiday h WHERE h.holiday_date = c.work_date
    AND h.applies_to IS NOT NULL AND (h.applies_to = e.employee_type
      OR e.employee_type NOT IN (SELECT applies_to FROM fx_holiday WHERE applies_to IS NOT NULL)))
  END AS holiday_name
FROM fx_claim c LEFT JOIN fx_employee e ON e.employee_id = c.employee_id""",
    "ck_pipe_rows": """
SELECT doc_id, pos, line, pos - ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY pos) AS grp
FROM (SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY raw_pos) AS pos, line
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
              generate_subscripts(string_split(text, chr(10)), 1) AS raw_pos FROM fx_table_text) a
      WHERE line NOT LIKE '|---%') b
WHERE trim(line) LIKE '|%|%'""",
    "ck_engine": """
SELECT *, CASE WHEN trim(text) = '' THEN 0 ELSE ROUND(table_rows * 2
   + CASE WHEN engine = 'ocr' THEN 0 ELSE 1 END + LEAST(CAST(length(text) AS DECIMAL(12,0)) * 0.002, 8.000)
   + confidence_pct * 0.01 * 3, 2) END AS score FROM fx_engine""",
    "ck_lines": """
SELECT *, SUM(CASE WHEN line = '=====' THEN 1 ELSE 0 END) OVER w AS page,
  SUM(CASE WHEN starts_with(line, 'Week') THEN 1 ELSE 0 END) OVER w AS sect,
  SUM(CASE WHEN line <> '' THEN 1 ELSE 0 END) OVER w - CASE WHEN line <> '' THEN 1 ELSE 0 END AS solid
FROM fx_line WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""",
    "ck_layout": """
SELECT file_id, row_no, part, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS col_no, unnest(CASE
  WHEN part = 'P' THEN ['Employee: Ana Lopez', '', '', '', '', '', '', '']
  WHEN part = 'H' AND layout = 0 THEN ['Date', 'Time In', 'Time Out', 'Break', 'Total Hours', 'Leave Type', 'Sick', 'Notes']
  WHEN part = 'H' AND layout = 1 THEN ['Work Date', 'Start', 'End', 'Lunch', 'Regular Hrs', 'Billable Hours', 'Daily Total', 'Status']
  WHEN part = 'H' THEN ['Day', 'Date', 'In', 'Out', 'Worked', 'Vacation', 'Update date', 'Category']
  WHEN layout = 0 THEN [d, i, o, b, w, l, s, 'x'] WHEN layout = 1 THEN [d, i, o, b, w, s, '', l]
  ELSE ['Mon', d, i, o, w, s, d, l] END) AS value FROM fx_grid""",
    "ck_form": """
SELECT doc_id, line_no, line, CAST(line_no % 16 AS INT) AS k, CAST(line_no % 3 AS INT) AS m,
  CAST(substr(CAST(e.ts AS VARCHAR), 9, 2) AS INT) AS dd, CAST(e.ts AS DATE) AS day, e.value
FROM fx_form f JOIN events e ON e.event_id = f.line_no""",
    "ck_form_rows": """
SELECT doc_id, line_no, k, CASE k WHEN 14 THEN CASE WHEN dd <= 12 THEN make_date(2024, dd, 1) ELSE day END
    WHEN 8 THEN day ELSE make_date(2024, 1, dd) END AS work_date,
  CASE k WHEN 8 THEN 8 WHEN 9 THEN line_no % 9 + 1.5 WHEN 10 THEN 10 WHEN 11 THEN dd ELSE line_no % 40 END AS total,
  CASE k WHEN 8 THEN 8 WHEN 9 THEN CASE WHEN line_no % 9 = 0 THEN 1.5 ELSE line_no % 9 END WHEN 10 THEN 8
    WHEN 11 THEN dd ELSE line_no % 40 END AS regular,
  CASE WHEN k = 9 AND line_no % 9 <> 0 THEN 1.5 WHEN k = 10 THEN 2 END AS overtime
FROM ck_form WHERE k IN (8, 9, 10, 11, 14)""",
    "ck_form_period": """
SELECT doc_id, CASE r WHEN 0 THEN DATE '2024-01-01' WHEN 1 THEN DATE '2024-01-01' ELSE DATE '2024-01-08' END AS p_start,
  CASE r WHEN 0 THEN DATE '2024-01-15' WHEN 1 THEN DATE '2024-01-31' ELSE DATE '2024-01-14' END AS p_end,
  CASE r WHEN 0 THEN 'RANGE' WHEN 1 THEN 'MONTH' ELSE 'WEEK' END AS kind
FROM (SELECT doc_id, MIN(CASE WHEN k = 7 AND m = 0 THEN 0 WHEN k = 7 AND m = 1 OR k = 10 THEN 1
        WHEN k = 7 THEN 2 END) AS r FROM ck_form GROUP BY doc_id) q WHERE r IS NOT NULL""",
    "ck_form_totals": """
SELECT doc_id, arg_min(sub, line_no) FILTER (sub > 0) AS submitted, arg_min(app, line_no) FILTER (app > 0) AS approved
FROM (SELECT doc_id, line_no, CASE WHEN k = 5 THEN CAST(CAST(value AS DECIMAL(10,2)) % 60 AS DECIMAL(5,1)) END AS sub,
        CASE WHEN k = 6 THEN line_no % 50 END AS app FROM ck_form) q GROUP BY doc_id""",
    "ck_judged": """
SELECT r.*, CASE WHEN total > 24 THEN 'IMPOSSIBLE_HOURS' WHEN total <= 0 THEN 'NO_HOURS'
  WHEN work_date < p_start OR work_date > p_end THEN 'OUTSIDE_PERIOD' END AS reason
FROM ck_form_rows r LEFT JOIN ck_form_period p ON p.doc_id = r.doc_id""",
    "ck_facts": """
SELECT file_id, COUNT(*) AS rows, COUNT(work_date) AS dated,
  COUNT(*) FILTER (COALESCE(entered_hours, 0) > 0 OR (in_min IS NOT NULL AND out_min IS NOT NULL)) AS with_hours,
  MIN(work_date) AS first_date, MAX(work_date) AS last_date, MAX(employee_id) AS name FROM ck_typed GROUP BY file_id""",
    "ck_scored": """
SELECT *, ROUND((rows * (CASE WHEN name IS NULL THEN 0 ELSE 25 END + CASE WHEN first_date IS NULL THEN 0 ELSE 10 END + 25)
  + 20 * (dated + with_hours)) / (100 * rows), 4) AS confidence FROM ck_facts""",
    "ck_sub": """
SELECT s.*, CAST(FLOOR(s.employee_id / 50) AS INT) AS batch_id,
  CASE WHEN s.employee_id % 3 <> 2 THEN s.employee_id * 5 END AS file_id,
  CASE WHEN COALESCE(bad, 0) > 0 THEN 'FAILED' ELSE 'PASSED' END AS validation_status,
  CASE WHEN COALESCE(bad, 0) > 0 THEN 'NOT_READY' ELSE 'READY' END AS payroll_status
FROM fx_submission s LEFT JOIN (SELECT submission_id, COUNT(*) AS bad FROM fx_finding
  WHERE status = 'OPEN' AND severity IN ('BLOCKER', 'ERROR') GROUP BY 1) f ON f.submission_id = s.submission_id""",
    "ck_money": """
SELECT s.*, COALESCE(t.regular_hours, 0) AS rh, COALESCE(t.overtime_hours, 0) AS oh, r.regular_rate AS rr,
  CASE WHEN COALESCE(r.overtime_rate, 0) = 0 THEN r.regular_rate * 1.5 ELSE r.overtime_rate END AS orate,
  CAST(COALESCE(t.regular_hours, 0) * r.regular_rate AS DECIMAL(18,2)) AS rp,
  CAST(COALESCE(t.overtime_hours, 0) * CASE WHEN COALESCE(r.overtime_rate, 0) = 0 THEN r.regular_rate * 1.5
    ELSE r.overtime_rate END AS DECIMAL(18,2)) AS op
FROM ck_sub s JOIN ck_rated r ON r.submission_id = s.submission_id
LEFT JOIN ck_totals t ON t.submission_id = s.submission_id""",
    "ck_final": """
SELECT b.*, COALESCE(payroll_ready, 0) AS payroll_ready, COALESCE(open_blockers, 0) AS open_blockers,
  CASE WHEN failed > 0 OR review > 0 OR COALESCE(open_blockers, 0) > 0 THEN 'NEEDS_REVIEW' ELSE 'PAYROLL_READY' END AS status
FROM (SELECT batch_id, COUNT(*) AS total, COUNT(*) FILTER (is_noise) AS ignored,
   COUNT(*) FILTER (is_duplicate) AS duplicates,
   COUNT(*) FILTER (processing_status IN ('COMPLETED', 'MATCHED', 'NORMALIZED')) AS processed,
   COUNT(*) FILTER (processing_status = 'FAILED') AS failed,
   COUNT(*) FILTER (processing_status IN ('NEEDS_REVIEW', 'EXTRACTION_FAILED')) AS review FROM fx_file GROUP BY 1) b
LEFT JOIN (SELECT batch_id, COUNT(*) FILTER (payroll_status = 'READY') AS payroll_ready FROM ck_sub GROUP BY 1) s USING (batch_id)
LEFT JOIN (SELECT batch_id, COUNT(*) FILTER (status = 'OPEN' AND severity = 'BLOCKER') AS open_blockers FROM fx_finding GROUP BY 1) f
  USING (batch_id)""",
    "ck_summary": """
SELECT f.batch_id, f.file_id, CASE WHEN regexp_matches(f.file_name, '^[-=+@]') THEN concat('''', f.file_name) ELSE f.file_name END AS file_name,
  f.folder_path, f.processing_status AS document_type,
  CASE WHEN detected_name LIKE '-%' THEN concat('''', detected_name) ELSE COALESCE(detected_name, '') END AS employee_candidate,
  CASE WHEN p.full_name LIKE '=%' THEN concat('''', p.full_name) ELSE COALESCE(p.full_name, '') END AS matched_employee,
  f.match_status, CASE WHEN match_percent IS NULL THEN '' ELSE concat(CAST(match_percent AS INT), '%') END AS match_confidence,
  f.extraction_method, f.processing_status AS extraction_status,
  concat(CAST(COALESCE(extraction_percent, 0) AS INT), '%') AS extraction_confidence, f.entry_count,
  CASE WHEN s.submission_id IS NULL THEN 'MISSING' ELSE CAST(CAST(COALESCE(h.c, 0) AS DECIMAL(18,2)) AS VARCHAR) END AS total_hours,
  CASE WHEN s.submission_id IS NULL THEN 'MISSING' ELSE CAST(CAST(COALESCE(h.r, 0) AS DECIMAL(18,2)) AS VARCHAR) END AS regular_hours,
  CASE WHEN s.submission_id IS NULL THEN 'MISSING' ELSE CAST(CAST(COALESCE(h.o, 0) AS DECIMAL(18,2)) AS VARCHAR) END AS overtime_hours,
  COALESCE(CAST(s.start_date AS VARCHAR), '') AS period_start, COALESCE(CAST(s.end_date AS VARCHAR), '') AS period_end,
  COALESCE(s.approval_status, '') AS approval_status,
  CASE WHEN s.submission_id IS NOT NULL THEN s.payroll_status WHEN NOT is_candidate THEN 'EXCLUDED' ELSE 'NOT_READY' END AS payroll_status,
  CASE WHEN s.submission_id IS NOT NULL THEN COALESCE(xs.bad, 0) ELSE COALESCE(xf.bad, 0) END AS blocker_count,
  CASE WHEN s.submission_id IS NOT NULL THEN COALESCE(xs.warn, 0) ELSE COALESCE(xf.warn, 0) END AS warning_count,
  CASE WHEN ocr_required THEN 'Yes' ELSE 'No' END AS ocr_used, CASE WHEN is_duplicate THEN 'Yes' ELSE 'No' END AS duplicate,
  COALESCE(NULLIF(concat_ws(' | ', CASE WHEN is_noise THEN 'NOISE_FILE' WHEN is_duplicate THEN 'DUPLICATE_FILE'
      WHEN f.processing_status IN ('UNSUPPORTED_FILE_TYPE', 'NON_TIMESHEET_DOCUMENT', 'NEEDS_REVIEW') THEN f.processing_status
      WHEN f.processing_status IN ('EXTRACTION_FAILED', 'FAILED') THEN 'EXTRACTION_FAILED'
      WHEN s.submission_id IS NULL AND is_candidate THEN 'MISSING_SUBMISSION' WHEN s.submission_id IS NULL THEN 'MISSING' END,
    CASE WHEN s.submission_id IS NULL THEN xf.codes END), ''), 'OK') AS notes
FROM fx_file f LEFT JOIN fx_people p ON p.employee_id = f.matched_employee_id
LEFT JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY submitted_at DESC, submission_id DESC) AS rn
  FROM ck_sub WHERE file_id IS NOT NULL) q WHERE rn = 1) s ON s.file_id = f.file_id
LEFT JOIN (SELECT submission_id, COALESCE(NULLIF(SUM(calculated_hours), 0), SUM(entered_hours), 0) AS c,
  SUM(regular_hours) AS r, SUM(overtime_hours) AS o FROM ck_weekly GROUP BY 1) h ON h.submission_id = s.submission_id
LEFT JOIN (SELECT submission_id, COUNT(*) FILTER (severity IN ('BLOCKER', 'ERROR')) AS bad,
  COUNT(*) FILTER (severity = 'WARNING') AS warn FROM fx_finding WHERE status = 'OPEN' GROUP BY 1) xs ON xs.submission_id = s.submission_id
LEFT JOIN (SELECT file_id, COUNT(*) FILTER (severity IN ('BLOCKER', 'ERROR')) AS bad, COUNT(*) FILTER (severity = 'WARNING') AS warn,
  string_agg(DISTINCT rule_code, ' | ' ORDER BY rule_code) AS codes FROM fx_finding WHERE status = 'OPEN' GROUP BY 1) xf ON xf.file_id = f.file_id""",
    "ck_probe": """
SELECT p.employee_id AS probe_id, CASE CAST(p.employee_id % 9 AS INT) WHEN 0 THEN full_name WHEN 1 THEN upper(full_name)
  WHEN 2 THEN split_part(full_name, ' ', 2) WHEN 3 THEN CONCAT(full_name, ' Junior') WHEN 4 THEN email
  WHEN 5 THEN CONCAT(split_part(full_name, ' ', 2), ' ', split_part(full_name, ' ', 1)) WHEN 6 THEN ''
  WHEN 7 THEN CONCAT('Timesheet ', full_name, ' April') ELSE 'Zed Unknown' END AS name,
  CASE CAST(p.employee_id % 9 AS INT) WHEN 0 THEN plain WHEN 1 THEN plain WHEN 2 THEN split_part(full_name, ' ', 2)
    WHEN 3 THEN CONCAT(plain, ' Junior') WHEN 4 THEN email WHEN 5 THEN CONCAT(split_part(plain, ' ', 2), ' ', split_part(plain, ' ', 1))
    WHEN 7 THEN plain WHEN 8 THEN 'Zed Unknown' END AS clean
FROM (SELECT *, CONCAT(split_part(full_name, ' ', 1), ' ', split_part(full_name, ' ', 2)) AS plain FROM fx_person) p
JOIN fx_employee e ON e.employee_id = p.employee_id""",
    "ck_roster": """
SELECT p.employee_id, lower(full_name) AS full_name, lower(CONCAT(split_part(full_name, ' ', 1), ' ', split_part(full_name, ' ', 2))) AS clean, email
FROM fx_person p JOIN fx_employee e ON e.employee_id = p.employee_id WHERE is_active""",
    "ck_exact": """
SELECT probe_id, employee_id, method FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY probe_id ORDER BY employee_id, rank) AS rn FROM (
  SELECT probe_id, employee_id, 1 AS rank, 'EXACT' AS method FROM ck_probe p JOIN ck_roster r ON r.full_name = lower(p.clean)
  UNION ALL SELECT probe_id, employee_id, 2, 'EMAIL_EXACT' FROM ck_probe p JOIN ck_roster r ON r.email = lower(p.clean)
  UNION ALL SELECT probe_id, employee_id, 3, 'EXACT_CLEANED' FROM ck_probe p JOIN ck_roster r ON r.clean = lower(p.clean)) u) q WHERE rn = 1""",
    "ck_contained": """
SELECT probe_id, employee_id, CASE WHEN inside THEN LEAST(0.95, 0.70 + 0.05 * n) ELSE LEAST(0.90, 0.65 + 0.05 * m) END AS confidence,
  CASE WHEN inside THEN 'PARTIAL_SUBSET' ELSE 'PARTIAL_SUPERSET' END AS method
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY probe_id ORDER BY employee_id) AS rn FROM (
  SELECT probe_id, employee_id, list_has_all(b, a) AS inside, len(a) AS n, len(b) AS m
  FROM (SELECT probe_id, list_distinct(string_split(lower(clean), ' ')) AS a FROM ck_probe WHERE clean IS NOT NULL) p,
       (SELECT employee_id, list_distinct(string_split(full_name, ' ')) AS b FROM ck_roster) r
  WHERE list_has_all(b, a) OR list_has_all(a, b)) j) q WHERE rn = 1""",
    "ck_sender": """
SELECT CAST(p.employee_id AS VARCHAR) AS message_id, CASE WHEN p.employee_id % 3 = 0 THEN email ELSE 'other@mail.test' END AS sender_email,
  CASE WHEN p.employee_id % 5 = 0 THEN '' ELSE CONCAT(split_part(full_name, ' ', 1), ' ', split_part(full_name, ' ', 2)) END AS sender_name
FROM fx_person p JOIN fx_employee e ON e.employee_id = p.employee_id""",
    "ck_scores": """
SELECT submission_id AS probe_id, entry_id AS employee_id, CAST(break_minutes AS DECIMAL(8,4)) * 0.01 + entered_hours * 0.02 AS score FROM fx_entry""",
}

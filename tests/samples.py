"""Small candidate and posting texts of our own wording."""

CV_STUDENT = """Jane Doe
Reliability Engineering Student
jane@mail.example | +216 22 333 444
Tunis, Tunisia

Summary
Final-year student with a taste for data. Works with rotating machines
and sensors.

Experience
Maintenance Intern | Acme Rail | Feb 2024 - Jul 2024
• Participated in AMDEC workshops (12 pumps)
and wrote the minutes with the team
• Cut downtime by 10% with planned maintenance.
Data Trainee, Beta, 2023, 3 months
- Wrote SQL reports in Power-BI for the plant managers

Skills
Programming: Python, R, SQL,
pandas
Languages: Python, SQL
Tools: SAP PM, sklearn

Education
Engineering degree in mechanical engineering
ENIT, 2022 - 2025 (expected)
Baccalaureat 2020

Languages
English (C1), French: native
"""

CV_BACKEND = """Max Muster
Backend Developer
max@mail.example

Experience
Backend Developer | Gamma | January 2021 - March 2024
• Built REST APIs in FastAPI and Django on PostgreSQL
• Moved the build to GitHub and Docker containers
• Wrote pytest suites for the payment service

Skills
Python, SQL, Docker, Kubernetes, Git, Kafka, AWS

Languages
German (native), English (B2)
"""

JOB_RELIABILITY = """We keep trains running.

Responsibilities
- Plan the upkeep of the fleet
Requirements
• 1 to 3 years of experience in reliability engineering
• FMEA and CMMS
• Python or MATLAB
• Fluent French
• Team player
• Degree in mechanical engineering
Nice to have
- DAX
- Weibull analysis
Benefits
- Lunch
"""

JOB_BACKEND = """About the team, we ship often.

You have
- 3+ years of experience with Python
- PostgreSQL and Docker
- TensorFlow
- Experience in building payment services for shops
Bonus
- Kubernetes
"""

JOB_COOK = """Cook for our canteen.

Requirements
- Experience with pastry
"""


def cv_rows():
    return [("student", CV_STUDENT), ("backend", CV_BACKEND)]


def posting_rows():
    return [
        ("j:rel", "greenhouse", "Greenhouse", "Rail Co", "Reliability Engineer", "Sfax, Tunisia", "onsite", "https://x.example/1", None, JOB_RELIABILITY, [], "Rail Co careers"),
        ("j:back", "lever", "Lever", "Shop Co", "Senior Backend Developer", "Remote (US only)", "remote", "", None, JOB_BACKEND, [], "Shop Co careers"),
        ("j:cook", "lever", "Lever", "Food Co", "Cook", "Paris", "onsite", "", None, JOB_COOK, [], None),
    ]

"""Policy texts: read from files, or built in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lendlane.schemas import POLICY_CHUNKS

# Fixed value: the policy used when no document is given.
BUILTIN_POLICY = """
Loan Eligibility Policy Document - BFSI Lending Division

1. GENERAL APPLICANT AGE CRITERIA
1.1 All applicants requesting retail lending products must be between the ages of 21 and 60 years at the time of application submission.
1.2 Requests from applicants outside of this age range are categorized as "Not Eligible" immediately. Age exceptions are subject to senior underwriting committee review and collateral backing.

2. INCOME BASELINES AND EMPLOYMENT STATUS
2.1 Minimum monthly verified net income required for loan eligibility is INR 30,000.
2.2 Applicants earning between INR 30,000 and INR 50,000 are classified as "Conditionally Eligible", requiring additional guarantors or security pledges.
2.3 Applicants with net monthly income of INR 50,000 and above meet the baseline income requirements for standard loan terms.
2.4 Salaried employees represent the lowest risk category and are preferred. Business owners and self-employed applicants are conditionally accepted based on 2 years of tax returns.
2.5 Unemployed applicants, students, and retired applicants are categorized as high-risk or Not Eligible unless sufficient co-signers or pension streams are verified.

3. CREDIT HISTORY AND BUREAU SCORES
3.1 The bank utilizes credit bureau scores ranging from 300 to 900.
3.2 Any applicant with a credit bureau score below 600 is classified as "Not Eligible" due to default history or high credit risk.
3.3 Credit scores between 600 and 749 are acceptable under conditional eligibility, subject to high-liability ratio review.
3.4 Credit scores of 750 and above represent excellent credit history and are fast-tracked for preferred interest rates.

4. EXISTING DEBT AND LIABILITIES
4.1 The Debt-to-Income (DTI) ratio is computed as total monthly existing EMIs divided by net monthly verified income.
4.2 A DTI ratio below 25% represents low liability and is preferred.
4.3 A DTI ratio between 25% and 40% is acceptable under conditional eligibility terms.
4.4 Any DTI ratio exceeding 40% represents excessive leverage and results in a "Not Eligible" verdict.

5. LOAN REQUEST LIMITS
5.1 The maximum allowable loan amount requested cannot exceed 20 times the verified monthly net income of the applicant.
5.2 Requested amounts exceeding this multiple are flagged as high risk and require loan reduction.
"""

# The lines used when a source has none.
BUILTIN_LINES = [
    "Section 1.5: Applicants must be between 21 and 60 years old at application date.",
    "Section 2.1: Minimum monthly income is INR 30,000. Preferred threshold is INR 50,000.",
    "Section 3.2: Credit score must be >= 600. Scores >= 750 receive premium pricing benefits.",
    "Section 4.4: Debt-to-income ratio must not exceed 40% including the requested EMI.",
    "Section 5.1: Maximum loan amount cannot exceed 20 times the verified monthly net income.",
    "Section 2.5: Unemployed applicants and students are categorized as high-risk.",
    "Section 4.2: DTI ratio below 25% is preferred. Between 25% and 40% is conditionally accepted.",
    "Section 3.1: Credit bureau scores range from 300 to 900. Scores below 600 result in rejection.",
    "Section 6.1: All documents must be verified by an authorized banking officer before approval.",
]


def policy_text(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Whole policy texts, one row per file; the built-in policy if no path is given."""
    if path is None:
        return spark.range(1).select(F.lit(BUILTIN_POLICY).alias("text"))
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def builtin_lines(spark: SparkSession) -> DataFrame:
    """The built-in lines as chunks "0", "1", …"""
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(BUILTIN_LINES)], POLICY_CHUNKS)

"""Labels, codes and column names the analysed tables use.

They are data definitions. Every operator takes them as arguments, so another
study passes its own.
"""

# Visit name -> visit code. A name that is not listed has no code.
VISIT_CODES = {
    "Prescreening Assessment 1": 1,
    "Prescreening Assessment 2": 2,
    "Prescreening Assessment 3": 3,
    "Prescreening Assessment 4": 4,
    "Medical Screening": 5,
    "Preparation 1": 6,
    "Preparation 2": 7,
    "Preparation 3": 8,
    "Preparation 4": 9,
    "Preparation 5": 10,
    "MRI 1": 11,
    "Drug Administration": 12,
    "Integration/MRI2": 13,
    "Follow-up 1": 14,
    "Follow-up 2": 15,
    "Follow-up 3": 16,
    "Follow-up 4": 17,
    "90-day Assessment": 18,
    "180-day Assessment": 19,
}

# Closed ranges of visit codes -> analysis period.
PERIOD_RANGES = [(1, 1, 1), (2, 6, 2), (7, 12, 3), (13, 17, 4), (18, 18, 5), (19, 19, 6)]
PERIODS = [1, 2, 3, 4, 5, 6]
POST_PERIODS = [4, 5, 6]

# Period -> column that holds the outcome of that period.
OUTCOME_BY_PERIOD = {
    1: "AB_Per_PreContact",
    2: "AB_Per_PreTX",
    3: "AB_Per_Preps",
    4: "AB_Per_PostDrugTX",
    (5, 6): "AB_Per_Follow_Ups",
}

# Category labels -> groups of the demographic summary, and level orders.
GENDER_LEVELS = ["Male", "Female"]
RACE_GROUPS = {"Caucasian/White": "White"}
RACE_LEVELS = ["Black", "White"]
ORIENTATION_GROUPS = {
    "Heterosexual": "Heterosexual",
    "Homosexual/Gay/Lesbian": "Gay",
    "Bisexual": "Bisexual",
    "none": "Heterosexual",
    "Pansexual": "Pansexual",
    "Asexual": "Asexual",
}
ORIENTATION_LEVELS = ["Heterosexual", "Gay", "Bisexual", "Pansexual", "Asexual"]
MARITAL_LEVELS = ["Single, never married", "Divorced or Separated", "Married", "Widowed"]
EMPLOYMENT_GROUPS = {
    "Employed": "Employed",
    "Unemployed": "Unemployed",
    "Retired": "Retired or disabled",
    "Full-time homemaker": "Homemaker",
    "Student (not employed)": "Student",
}
EMPLOYMENT_LEVELS = ["Employed", "Unemployed", "Retired or disabled", "Homemaker", "Student"]
INCOME_LEVELS = [
    "Less than $10,000", "$11,000 - $20,000", "$21,000 - $30,000", "$31,000 - $40,000",
    "$41,000 - $50,000", "$51,000 - $60,000", "$61,000 - $70,000", "$91,000 - $100,000",
]
EDUCATION_GROUPS = {
    "less than a High School degree": "Less than a high school degree",
    "High School, GED": "High school degree",
    "A.A., A.S., Other Vocational Program": "Associate's degree/vocational training",
    "B.A., B.S., Etc.": "Bachelor's degree",
    "M.A., M.S., Etc.": "Bachelor's degree",
    "Ph.D., M.D., J.D., Etc.": "Bachelor's degree",
}
EDUCATION_YEARS = [
    (None, 11, "Less than a high school degree"),
    (12, 12, "High school degree"),
    (13, 15, "Associate's degree/vocational training"),
    (16, None, "Bachelor's degree"),
]
EDUCATION_LEVELS = [
    "Less than a high school degree", "High school degree",
    "Associate's degree/vocational training", "Bachelor's degree",
]
HOUSING_GROUPS = {
    "House or Apartment (you own or rent)": "Stable housing",
    "House or Apartment of friend or relative": "Stable housing",
    "Homeless (streets, shelter, car, no stable arrangement)": "Experiencing homelessness",
    "Halfway House or Residence in therapeutic community": "Halfway house/therapeutic community",
}
HOUSING_LEVELS = ["Stable housing", "Experiencing homelessness", "Halfway house/therapeutic community"]
YES_NO_LEVELS = ["No", "Yes"]
YES_NO_CODES = {"1": "Yes", "Yes": "Yes", "0": "No", "No": "No"}
ROUTE_LEVELS = ["Smoking", "Snorting", "Both smoking and snorting"]

# Labels of the two summary tables.
DEMOGRAPHIC_LABELS = {
    "gender": "Gender",
    "race": "Ethnic Origin",
    "age": "Age (years)",
    "orientation": "Sexual Orientation",
    "marital": "Marital Status",
    "employment": "Employment Status",
    "income": "Annual Individual Income",
    "education": "Educational Attainment",
    "housing": "Living Situation",
    "veteran": "US Armed Forces Veteran",
}
USE_HISTORY_LABELS = {
    "route": "Preferred route of cocaine administration",
    "age_first_use": "Age at first cocaine use, median (IQR), y",
    "age_regular_use": "Age of onset of regular cocaine use, median (IQR), y",
    "quit_attempts": "No. of prior cocaine quit attempts, median (IQR)",
    "treatment": "Lifetime history of treatment for cocaine use",
    "quit_longest": "Longest duration of cocaine abstinence, median (IQR), d",
    "tobacco_daily": "Daily tobacco use in the past 90 d",
    "any_heavy_drinking": "Any heavy drinking in the past 90 d",
    "heavy_drinking_pct": "Heavy drinking days among those reporting any heavy drinking, median (IQR), %",
    "any_cannabis": "Any cannabis use in the past 90 d",
    "cannabis_pct": "Cannabis use days among those reporting any cannabis use, median (IQR), %",
    "any_depressant": "Any nonmedical depressant use in the past 90 d",
    "any_stimulant": "Any methamphetamine or nonmedical stimulant use in the past 90 d",
    "any_opioid": "Any nonmedical opioid use in the past 90 d",
    "any_heroin": "Any heroin use in the past 90 d",
    "prior_hallucinogen": "Lifetime history of hallucinogen use",
}

# The instrument's item columns and the pattern of their names.
SCALE_ITEMS = ["CQ_Cred1", "CQ_Cred2", "CQ_Cred3", "CQ_Exp1", "CQ_Exp2", "CQ_Exp3"]
SCALE_PATTERN = "CQ_(Cred|Exp)([123])"

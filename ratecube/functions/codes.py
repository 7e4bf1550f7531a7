"""Code tables.

Everything in this module is a fixed value: the codes are those of the input
files and the labels are those of the result tables, so neither may change.
"""

# --- fixed values: residence and birthplace -------------------------------
# (FIPS number, postal code) of the 50 states and the District of Columbia.
STATE_FIPS = [
    (1, "AL"), (2, "AK"), (4, "AZ"), (5, "AR"), (6, "CA"), (8, "CO"),
    (9, "CT"), (10, "DE"), (11, "DC"), (12, "FL"), (13, "GA"), (15, "HI"),
    (16, "ID"), (17, "IL"), (18, "IN"), (19, "IA"), (20, "KS"), (21, "KY"),
    (22, "LA"), (23, "ME"), (24, "MD"), (25, "MA"), (26, "MI"), (27, "MN"),
    (28, "MS"), (29, "MO"), (30, "MT"), (31, "NE"), (32, "NV"), (33, "NH"),
    (34, "NJ"), (35, "NM"), (36, "NY"), (37, "NC"), (38, "ND"), (39, "OH"),
    (40, "OK"), (41, "OR"), (42, "PA"), (44, "RI"), (45, "SC"), (46, "SD"),
    (47, "TN"), (48, "TX"), (49, "UT"), (50, "VT"), (51, "VA"), (53, "WA"),
    (54, "WV"), (55, "WI"), (56, "WY"),
]
STATES = [postal for _, postal in STATE_FIPS]
TERRITORIES = ["PR", "VI", "GU", "AS", "MP"]

# Birth country of a death record -> birthplace group.
FOREIGN_BIRTH_CODES = [
    ("CC", "Canada"),
    ("CU", "Cuba"),
    ("MX", "Mexico"),
    ("YY", "Rest of world"),
]
# Birthplace of a survey person: born in a state, DC, a territory or at sea ...
NATIVE_BPL_RANGE = (1, 56)
NATIVE_BPL_CODES = [90, 99, 100, 105, 110, 115, 120]
# ... or abroad, with three countries shown by name.
FOREIGN_BPL_RANGE = (150, 950)
FOREIGN_BPL_CODES = [(150, "Canada"), (200, "Mexico"), (250, "Cuba")]
FOREIGN_TOTAL = "Foreign total"

NATIVITY_LABELS = [("native", "Native-born"), ("foreign", "Foreign-born")]
TOTAL_SERIES = "Total U.S."

# --- fixed values: age ------------------------------------------------------
# (code, first year, last year or None, label, weight in the 2000 standard population)
AGE_BANDS = [
    ("01", 0, 0, "Under 1 year", 0.013818),
    ("02", 1, 4, "1-4 years", 0.055317),
    ("03", 5, 14, "5-14 years", 0.145565),
    ("04", 15, 24, "15-24 years", 0.138646),
    ("05", 25, 34, "25-34 years", 0.135573),
    ("06", 35, 44, "35-44 years", 0.162613),
    ("07", 45, 54, "45-54 years", 0.134834),
    ("08", 55, 64, "55-64 years", 0.087247),
    ("09", 65, 74, "65-74 years", 0.066037),
    ("10", 75, 84, "75-84 years", 0.044842),
    ("11", 85, None, "85 years and over", 0.015508),
]
AGE_UNKNOWN = "12"
AGE_IN_YEARS = "1"
AGE_LABELS = [(code, label) for code, _, _, label, _ in AGE_BANDS]
STANDARD_WEIGHTS = [(code, weight) for code, _, _, _, weight in AGE_BANDS]

# --- fixed values: sex, marital status --------------------------------------
SEX_LABELS = [("M", "Male"), ("F", "Female")]
SURVEY_SEX = [(1, "M"), (2, "F")]
MARITAL_LABELS = [
    ("S", "Never married, single"),
    ("M", "Married"),
    ("W", "Widowed"),
    ("D", "Divorced"),
    ("U", "Unknown"),
]
SURVEY_MARITAL = [
    (1, "Married"),
    (2, "Married"),
    (3, "Married"),
    (4, "Divorced"),
    (5, "Widowed"),
    (6, "Never married, single"),
]

# --- fixed values: race and ethnicity ---------------------------------------
# (first code, last code or None for "and every later code", label)
RACE5_RANGES = [
    ("01", "01", "White"),
    ("02", "02", "Black"),
    ("03", "03", "AIAN"),
    ("04", "14", "Asian or Pacific Islander"),
    ("15", None, "More than one race"),
]
RACE12_RANGES = [
    ("01", "01", "White"),
    ("02", "02", "Black"),
    ("03", "03", "AIAN"),
    ("04", "04", "Asian Indian"),
    ("05", "05", "Chinese"),
    ("06", "06", "Filipino"),
    ("07", "07", "Japanese"),
    ("08", "08", "Korean"),
    ("09", "09", "Vietnamese"),
    ("10", "10", "Other or Multiple Asian"),
    ("11", "14", "Pacific Islander"),
    ("15", None, "More than one race"),
]
# Survey race 7 (other race) has no counterpart in the records and stays out.
SURVEY_RACE_RANGES = [
    (1, 1, "White"),
    (2, 2, "Black"),
    (3, 3, "AIAN"),
    (4, 6, "Asian or Pacific Islander"),
    (8, 9, "More than one race"),
]
ETHNICITY2_RANGES = [(100, 199, "Non-Hispanic"), (200, 299, "Hispanic")]
ETHNICITY11_RANGES = [
    (100, 199, "Non-Hispanic"),
    (200, 209, "Spaniard"),
    (210, 219, "Mexican"),
    (220, 230, "Central American"),
    (231, 249, "South American"),
    (250, 259, "Latin American"),
    (260, 269, "Puerto Rican"),
    (270, 274, "Cuban"),
    (275, 279, "Dominican"),
    (280, 299, "Other Hispanic"),
    (996, 999, "Unknown"),
]
SURVEY_ETHNICITY_RANGES = [(0, 0, "Non-Hispanic"), (1, 4, "Hispanic")]

# --- fixed values: causes ---------------------------------------------------
HOMICIDE_CAUSES = ["128", "129"]
FIREARM_CAUSE = "128"
METHOD_FIREARM = "Firearm"
METHOD_OTHER = "Other assault"
CAUSE_LABELS = [
    ("001", "Salmonella infections"),
    ("002", "Shigellosis and amebiasis"),
    ("003", "Certain other intestinal infections"),
    ("005", "Respiratory tuberculosis"),
    ("006", "Other tuberculosis"),
    ("007", "Whooping cough"),
    ("008", "Scarlet fever and erysipelas"),
    ("009", "Meningococcal infection"),
    ("010", "Septicemia"),
    ("011", "Syphilis"),
    ("012", "Acute poliomyelitis"),
    ("013", "Arthropod-borne viral encephalitis"),
    ("014", "Measles"),
    ("015", "Viral hepatitis"),
    ("016", "HIV disease"),
    ("017", "Malaria"),
    ("018", "Other/unspecified infectious and parasitic diseases"),
    ("020", "Cancer: lip, oral cavity and pharynx"),
    ("021", "Cancer: esophagus"),
    ("022", "Cancer: stomach"),
    ("023", "Cancer: colon, rectum and anus"),
    ("024", "Cancer: liver and intrahepatic bile ducts"),
    ("025", "Cancer: pancreas"),
    ("026", "Cancer: larynx"),
    ("027", "Cancer: trachea, bronchus and lung"),
    ("028", "Malignant melanoma of skin"),
    ("029", "Cancer: breast"),
    ("030", "Cancer: cervix uteri"),
    ("031", "Cancer: corpus uteri/uterus NOS"),
    ("032", "Cancer: ovary"),
    ("033", "Cancer: prostate"),
    ("034", "Cancer: kidney and renal pelvis"),
    ("035", "Cancer: bladder"),
    ("036", "Cancer: meninges, brain, other CNS"),
    ("038", "Hodgkin disease"),
    ("039", "Non-Hodgkin lymphoma"),
    ("040", "Leukemia"),
    ("041", "Multiple myeloma and immunoproliferative neoplasms"),
    ("042", "Other lymphoid/hematopoietic cancer"),
    ("043", "All other malignant neoplasms"),
    ("044", "In situ/benign neoplasms, uncertain behavior"),
    ("045", "Anemias"),
    ("046", "Diabetes mellitus"),
    ("047", "Nutritional deficiencies"),
    ("048", "Malnutrition"),
    ("049", "Other nutritional deficiencies"),
    ("050", "Meningitis"),
    ("051", "Parkinson disease"),
    ("052", "Alzheimer disease"),
    ("055", "Acute rheumatic fever and chronic rheumatic heart disease"),
    ("056", "Hypertensive heart disease"),
    ("057", "Hypertensive heart and renal disease"),
    ("059", "Acute myocardial infarction"),
    ("060", "Other acute ischemic heart disease"),
    ("062", "Atherosclerotic cardiovascular disease"),
    ("063", "Other chronic ischemic heart disease"),
    ("065", "Acute and subacute endocarditis"),
    ("066", "Diseases of pericardium/acute myocarditis"),
    ("067", "Heart failure"),
    ("068", "All other heart disease"),
    ("069", "Essential hypertension and hypertensive renal disease"),
    ("070", "Cerebrovascular diseases (stroke)"),
    ("071", "Atherosclerosis"),
    ("073", "Aortic aneurysm and dissection"),
    ("074", "Other diseases of arteries/arterioles/capillaries"),
    ("075", "Other disorders of circulatory system"),
    ("077", "Influenza"),
    ("078", "Pneumonia"),
    ("080", "Acute bronchitis and bronchiolitis"),
    ("081", "Other acute lower respiratory infections"),
    ("083", "Chronic bronchitis"),
    ("084", "Emphysema"),
    ("085", "Asthma"),
    ("086", "Other chronic lower respiratory disease"),
    ("087", "Pneumoconioses and chemical effects"),
    ("088", "Pneumonitis due to solids/liquids"),
    ("089", "Other diseases of respiratory system"),
    ("090", "Peptic ulcer"),
    ("091", "Diseases of appendix"),
    ("092", "Hernia"),
    ("094", "Alcoholic liver disease"),
    ("095", "Other chronic liver disease and cirrhosis"),
    ("096", "Cholelithiasis/gallbladder disorders"),
    ("098", "Acute/rapidly progressive nephritic and nephrotic syndrome"),
    ("099", "Chronic glomerulonephritis/nephritis/nephropathy"),
    ("100", "Renal failure"),
    ("101", "Other disorders of kidney"),
    ("102", "Infections of kidney"),
    ("103", "Hyperplasia of prostate"),
    ("104", "Inflammatory diseases of female pelvic organs"),
    ("106", "Pregnancy with abortive outcome"),
    ("107", "Other complications of pregnancy/childbirth/puerperium"),
    ("108", "Conditions originating in the perinatal period"),
    ("109", "Congenital malformations/deformations/chromosomal abnormalities"),
    ("110", "Symptoms, signs, abnormal findings NEC"),
    ("111", "All other diseases (residual)"),
    ("114", "Motor vehicle accidents"),
    ("115", "Other land transport accidents"),
    ("116", "Water/air/space and other transport accidents"),
    ("118", "Falls"),
    ("119", "Accidental discharge of firearms"),
    ("120", "Accidental drowning and submersion"),
    ("121", "Accidental exposure to smoke, fire and flames"),
    ("122", "Accidental poisoning/exposure to noxious substances"),
    ("123", "Other/unspecified nontransport accidents"),
    ("125", "Suicide by discharge of firearms"),
    ("126", "Suicide by other/unspecified means"),
    ("128", "Homicide by discharge of firearms"),
    ("129", "Homicide by other/unspecified means"),
    ("130", "Legal intervention"),
    ("132", "Discharge of firearms, undetermined intent"),
    ("133", "Other/unspecified events of undetermined intent"),
    ("134", "Operations of war and their sequelae"),
    ("135", "Complications of medical and surgical care"),
]
CAUSE_FALLBACK = ("Code ", " (not in lookup - check codebook)")

# --- fixed values: reporting rules --------------------------------------------
PER_100K = 100_000.0
MIN_REPORTABLE = 10
TOP_CAUSES = 10
CODE_WIDTH = 5
FIRST_YEAR, LAST_YEAR = 2014, 2024
EDUCATION_FLAG_BEFORE = 2018

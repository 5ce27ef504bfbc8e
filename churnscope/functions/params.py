"""Parameters of the analytics.

Everything below the FIXED VALUES marker must equal the values the reference
application uses (column aliases, defaults, label dictionaries, topic word
lists, thresholds), otherwise results differ.  They are stated plainly, in the
reference's natural order.  Operators take these as default arguments so a
caller can pass other dictionaries (the test fixtures do, see FIXTURES.md).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference)
# ---------------------------------------------------------------------------

# Column renames applied when the target column is absent (first alias wins).
RENAME_ALIASES = [
    ("部门", "Department"),
    ("岗位", "JobRole"),
    ("工号", "EmployeeNumber"),
    ("员工号", "EmployeeNumber"),
    ("年龄", "Age"),
    ("司龄", "YearsAtCompany"),
    ("月薪", "MonthlyIncome"),
    ("是否加班", "OverTime"),
    ("离职", "Attrition"),
]

# Numeric columns with their fill value when missing or unparsable.
NUMERIC_DEFAULTS = {
    "Age": 30.0,
    "YearsAtCompany": 3.0,
    "MonthlyIncome": 10000.0,
    "DistanceFromHome": 10.0,
    "YearsSinceLastPromotion": 1.0,
    "JobSatisfaction": 3.0,
    "WorkLifeBalance": 3.0,
    "EnvironmentSatisfaction": 3.0,
    "RelationshipSatisfaction": 3.0,
    "JobInvolvement": 3.0,
    "NumCompaniesWorked": 2.0,
    "PercentSalaryHike": 12.0,
    "TotalWorkingYears": 8.0,
    "TrainingTimesLastYear": 2.0,
    "YearsInCurrentRole": 3.0,
    "YearsWithCurrManager": 3.0,
}

# Yes/No canonicalisation dictionaries (anything else becomes "No").
ATTRITION_VALUES = {"1": "Yes", "0": "No", "yes": "Yes", "no": "No", "YES": "Yes", "NO": "No"}
OVERTIME_VALUES = {"1": "Yes", "0": "No", "Y": "Yes", "N": "No",
                   "yes": "Yes", "no": "No", "YES": "Yes", "NO": "No"}
# Our documented change (defect R10): float labels are accepted too.
FLOAT_LABEL_VALUES = {"1.0": "Yes", "0.0": "No"}

# Descriptive columns filled with "--" when absent.
DASH_DEFAULT_COLUMNS = ["Gender", "BusinessTravel", "MaritalStatus"]

# Predicted / actual label columns of a scored table.
PREDICTED_LABEL_COL = "预测流失标签"
ACTUAL_LABEL_COL = "实际流失标签"
PROBABILITY_OUT_COL = "流失概率"
THRESHOLD_OUT_COL = "预测阈值"
SEGMENT_OUT_COL = "风险分层"

# Probability column candidates, in priority order.
PROB_COLUMN_CANDIDATES = ["流失概率", "离职概率", "预测概率", "AttritionProb", "attrition_prob",
                          "prob", "Probability"]

# Risk level cut-offs: >= 0.60 high, >= 0.35 medium, else low.
RISK_HIGH = 0.60
RISK_MEDIUM = 0.35
RISK_LEVELS = ["Low Risk", "Medium Risk", "High Risk"]

# Income compa-ratio clip range.
COMPA_MIN, COMPA_MAX = 0.5, 1.8

# Tenure buckets: right-closed edges and labels.
TENURE_EDGES = [-1, 1, 3, 5, 8, 100]
TENURE_LABELS = ["<1y", "1-3y", "3-5y", "5-8y", "8y+"]

# Satisfaction measures and their display names.
SATISFACTION_COLUMNS = ["JobSatisfaction", "WorkLifeBalance", "EnvironmentSatisfaction",
                        "RelationshipSatisfaction"]
SATISFACTION_NAMES = ["Job Satisfaction", "Work-Life Balance", "Environment", "Relationships"]

# Numeric features correlated with the attrition flag.
CORR_FEATURES = ["Age", "DistanceFromHome", "MonthlyIncome", "NumCompaniesWorked",
                 "PercentSalaryHike", "TotalWorkingYears", "TrainingTimesLastYear",
                 "YearsAtCompany", "YearsInCurrentRole", "YearsSinceLastPromotion",
                 "YearsWithCurrManager"]

# Correlation matrix columns.
MATRIX_COLUMNS = ["AttritionProb", "Age", "MonthlyIncome", "DistanceFromHome", "JobSatisfaction",
                  "WorkLifeBalance", "YearsAtCompany", "YearsSinceLastPromotion",
                  "NumCompaniesWorked", "PercentSalaryHike"]

# Feature-impact proxy features (one-hot pseudo features included).
IMPACT_FEATURES = ["OverTime_No", "StockOptionLevel", "YearsWithCurrManager", "JobSatisfaction",
                   "EnvironmentSatisfaction", "DistanceFromHome", "NumCompaniesWorked",
                   "JobRole_Research Scientist", "TravelRisk", "Age_WorkBalance",
                   "MonthlyIncome_log", "JobInvolvement", "RelationshipSatisfaction", "Age",
                   "JobRole_Laboratory Technician", "YearsSinceLastPromotion",
                   "Income_per_YearAtCompany", "JobLevel", "TotalWorkingYears",
                   "PercentSalaryHike"]
IMPACT_SCALE = 2.6
IMPACT_CLIP = 4.5
IMPACT_MIN_ROWS = 8

# Radar axes.
RADAR_AXES = ["Attrition Prob", "Overtime", "Low Satisfaction", "Low Work-Life",
              "Promotion Stall", "Below Median Pay", "Distance"]

# Early-warning reasons, in rule order, and the default.
WARNING_REASONS = ["Overtime", "Low satisfaction", "Poor work-life balance",
                   "Long since last promotion", "Below role median pay"]
WARNING_DEFAULT = "Review recommended"

# Pearson strength bands.
PEARSON_BANDS = [(0.10, "Very Weak"), (0.30, "Weak"), (0.50, "Moderate")]
PEARSON_STRONG = "Strong"

# Policy table column candidates.
POLICY_COLUMN_CANDIDATES = {
    "title": ["文章标题", "标题", "title", "政策标题", "文件标题", "名称"],
    "content": ["正文内容", "内容", "body", "正文", "政策内容", "主要内容", "摘要"],
    "time": ["发布时间", "发布日期", "time", "date", "publish_date", "发文时间", "发布时间间"],
    "role": ["适用岗位", "岗位", "job_role", "岗位名称", "岗位类别", "职位", "适用对象", "适用群体"],
    "department": ["适用部门", "部门", "department", "所属部门", "适用业务条线"],
    "source": ["来源", "政策来源", "发布机构", "发布单位", "发文机关"],
}

JOB_ROLE_ALIAS_GROUPS = {
    "Sales Executive": ["sales executive", "salesexecutive", "销售主管", "销售经理", "销售专员", "销售执行", "销售顾问"],
    "Research Scientist": ["research scientist", "researchscientist", "研究科学家", "科研人员", "研发人员", "研究员"],
    "Laboratory Technician": ["laboratory technician", "laboratorytechnician", "实验室技术员", "检验技术员", "技术员", "实验员"],
    "Manufacturing Director": ["manufacturing director", "manufacturingdirector", "制造总监", "生产总监", "制造负责人", "生产负责人"],
    "Healthcare Representative": ["healthcare representative", "healthcarerepresentative", "医疗代表", "医药代表", "健康顾问"],
    "Manager": ["manager", "管理者", "经理", "主管"],
    "Sales Representative": ["sales representative", "salesrepresentative", "销售代表", "业务代表"],
    "Research Director": ["research director", "researchdirector", "研发总监", "研究总监", "科研总监"],
    "Human Resources": ["human resources", "humanresources", "hr", "人力资源", "人事"],
}

DEPARTMENT_ALIAS_GROUPS = {
    "Sales": ["sales", "销售", "市场销售"],
    "Research & Development": ["researchdevelopment", "research&development", "r&d", "研发", "研究开发", "技术研发", "科研"],
    "Human Resources": ["human resources", "humanresources", "hr", "人力资源", "人事"],
}

# Topic rules: key -> (label, keywords).
POLICY_TOPICS = {
    "compensation": ("薪酬激励", ["补贴", "津贴", "薪酬", "工资", "奖金", "绩效", "福利", "社保", "公积金", "激励"]),
    "development": ("培训发展", ["培训", "培养", "学习", "技能", "课程", "研修", "能力提升", "导师", "继续教育"]),
    "promotion": ("晋升成长", ["晋升", "职级", "成长", "发展通道", "人才梯队", "职业发展", "晋级", "骨干"]),
    "worklife": ("工作生活", ["弹性", "休假", "加班", "工时", "差旅", "平衡", "双休", "远程", "调休"]),
    "environment": ("环境氛围", ["环境", "文化", "氛围", "团队", "办公", "协同", "体验", "满意度"]),
    "recognition": ("认可表彰", ["表彰", "荣誉", "奖励", "评优", "认可", "先进", "嘉奖"]),
    "housing": ("住房保障", ["住房", "租房", "通勤", "落户", "安家", "交通", "宿舍", "购房"]),
    "care": ("关怀保障", ["健康", "医疗", "子女", "家庭", "托育", "保险", "心理", "关怀", "帮扶", "慰问"]),
}
TOPIC_KEYS = list(POLICY_TOPICS)
DEFAULT_TOPIC_LABEL = "综合支持"
TOPIC_LABEL_SEP = "、"
POSITIVE_WORDS = ["支持", "补贴", "奖励", "扶持", "优惠", "资助", "鼓励", "提升", "保障", "优化"]
NEGATIVE_WORDS = ["取消", "减少", "撤销", "处罚", "限制", "收紧", "压减", "叫停", "约束"]

# Time decay half-life in days.
TIME_DECAY_HALF_LIFE_DAYS = 180

# Policy score weights: hotness, semantic, time, topic strength, support bias.
POLICY_SCORE_WEIGHTS = (0.28, 0.24, 0.22, 0.16, 0.10)

# TF-IDF vocabulary caps and n-gram range.
HOTNESS_MAX_FEATURES = 2000
EMBED_MAX_FEATURES = 1024
EMBED_MIN_FEATURES = 128
EMBED_FEATURES_PER_TEXT = 8
NGRAM_RANGE = (2, 4)
EMPTY_TEXT = "空文本"

# Employee need rules: profile fragments, in rule order.
PROFILE_ROLE_PREFIX = "岗位 "
PROFILE_DEPT_PREFIX = "部门 "
PROFILE_EDU_PREFIX = "专业 "
PROFILE_NEEDS_PREFIX = "重点需求 "
PROFILE_SEP = "；"
FRAG_OVERTIME = "关注加班治理 弹性休假 健康关怀"
FRAG_TRAVEL = "关注差旅补贴 工作生活平衡"
FRAG_WORKLIFE = "关注工作生活平衡 心理健康 员工关怀"
FRAG_INCOME = "关注薪酬补贴 福利激励"
FRAG_PROMOTION = "关注晋升发展 职级成长"
FRAG_TRAINING = "关注培训学习 技能提升"
FRAG_ENVIRONMENT = "关注工作环境 团队氛围 员工关怀"
FRAG_HOUSING = "关注住房交通 通勤补贴"
FRAG_YOUTH = "关注青年人才培养 职业发展"
FRAG_RECOGNITION = "关注认可激励 荣誉表彰"

# Match boosts: role hit / miss, department hit / miss.
ROLE_BOOST_HIT, ROLE_BOOST_MISS = 1.20, 0.88
DEPT_BOOST_HIT, DEPT_BOOST_MISS = 1.10, 0.93

# Macro index.
MACRO_MEAN_WEIGHT = 0.85
MACRO_COUNT_WEIGHT = 15.0
MACRO_GAP_LIMIT = 50.0
MACRO_EMPTY_DEFAULT = 50.0

# Model evaluation constants.
RANDOM_STATE = 42
TEST_SIZE = 0.2

# ---------------------------------------------------------------------------
# Test dictionaries (FIXTURES.md): the synthetic documents contain none of the
# Chinese words above, so the driver queries pass these instead.
# ---------------------------------------------------------------------------
FIXTURE_TOPICS = {
    "compensation": (POLICY_TOPICS["compensation"][0], ["the", "of"]),
    "development": (POLICY_TOPICS["development"][0], ["and"]),
    "promotion": (POLICY_TOPICS["promotion"][0], ["der", "die", "und"]),
    "worklife": (POLICY_TOPICS["worklife"][0], ["que", "os"]),
    "environment": (POLICY_TOPICS["environment"][0], ["la", "le"]),
    "recognition": (POLICY_TOPICS["recognition"][0], ["for", "by"]),
    "housing": (POLICY_TOPICS["housing"][0], ["el", "un"]),
    "care": (POLICY_TOPICS["care"][0], ["with", "ou"]),
}
FIXTURE_POSITIVE = ["to", "en"]
FIXTURE_NEGATIVE = ["er", "on"]

# FIXED VALUE: how a missing category is shown
MISSING_CATEGORY = "nan"

# FIXED VALUES: names of the 33 run metrics, in the export's order
METRIC_LABELS = {
    "train_auc": "训练集AUC",
    "valid_auc": "验证集AUC",
    "test_auc": "测试集AUC",
    "train_acc": "训练集Accuracy",
    "valid_acc": "验证集Accuracy",
    "test_acc": "测试集Accuracy",
    "train_f1": "训练集F1",
    "valid_f1": "验证集F1",
    "test_f1": "测试集F1",
    "train_precision": "训练集Precision",
    "valid_precision": "验证集Precision",
    "test_precision": "测试集Precision",
    "train_recall": "训练集Recall",
    "valid_recall": "验证集Recall",
    "test_recall": "测试集Recall",
    "train_pred_positive_rate": "训练集预测流失率",
    "valid_pred_positive_rate": "验证集预测流失率",
    "test_pred_positive_rate": "测试集预测流失率",
    "best_threshold": "基础阈值",
    "high_risk_threshold": "高风险组阈值",
    "standard_threshold": "常规组阈值",
    "train_high_risk_share": "训练集高风险占比",
    "test_high_risk_share": "测试集高风险占比",
    "blend_lgb_weight": "融合权重-LGB",
    "blend_lr_weight": "融合权重-LR",
    "blend_et_weight": "融合权重-ET",
    "threshold_strategy": "阈值策略",
    "ensemble_strategy": "集成策略",
    "feature_strategy": "特征策略",
    "probability_calibration": "概率校准",
    "selected_num_features": "数值特征数量",
    "selected_cat_features": "类别特征数量",
    "selected_total_features": "总特征数量",
}
# FIXED VALUES: the metrics of the short table
CORE_METRICS = [
    "train_auc", "valid_auc", "test_auc", "train_acc", "valid_acc", "test_acc", "train_f1", "valid_f1", "test_f1",
    "train_precision", "valid_precision", "test_precision", "train_recall", "valid_recall", "test_recall",
    "test_pred_positive_rate", "best_threshold", "high_risk_threshold", "standard_threshold",
    "train_high_risk_share", "test_high_risk_share",
]

"""Template sets for synthetic office utterances (GE-1..GE-3).

Each label has one or more template groups; a group is a list of templates
with ``{slot}`` holes and the vocabulary for its slots (slot order as listed).
"""

from __future__ import annotations

# Templates and slot vocabularies of the reference generator,
# per label, in their original order.
TEMPLATE_SETS = {
    "CHECK_PAYSLIP": [(
        ["我想查看{period}的工资单", "帮我查询{period}{type}", "我需要看一下{period}的{type}",
         "{period}的工资是多少？", "查看我的{period}{type}", "能帮我查询{period}的{type}吗？",
         "我要看{period}的薪资明细", "请显示我的{period}{type}", "{period}发了多少工资？",
         "我需要{period}的{type}信息"],
        {"period": ["这个月", "上个月", "本月", "上月", "当月", "这月", "月底", "本年度", "今年", "去年"],
         "type": ["工资单", "薪资", "工资", "薪水", "收入", "薪酬", "工资条", "薪资单", "收入明细"]},
    )],
    "BOOK_MEETING_ROOM": [(
        ["我想预订{time}的{room_type}", "能帮我订一个{room_type}{time}用吗？", "我需要预约{time}的{room_type}",
         "{time}有{room_type}可以预订吗？", "想订{time}的{room_type}", "请帮我安排{time}的{room_type}",
         "我要预定{room_type}，{time}", "能预约{time}的{room_type}吗？", "帮忙订个{room_type}，{time}用",
         "{time}我需要用{room_type}"],
        {"room_type": ["会议室", "大会议室", "小会议室", "培训室", "讨论室", "视频会议室", "多媒体室"],
         "time": ["明天上午", "下午两点", "明天下午", "后天", "周一", "周五下午", "明天十点", "下周", "今天下午"]},
    )],
    "REQUEST_LEAVE": [(
        ["我想请{leave_type}{time}", "我需要{time}请{leave_type}", "能帮我申请{time}的{leave_type}吗？",
         "我要{time}请{leave_type}", "{time}我想请{leave_type}", "申请{time}的{leave_type}",
         "我想{time}休{leave_type}", "需要请{leave_type}，{time}", "{time}我要请假",
         "帮我申请{leave_type}，{time}"],
        {"leave_type": ["病假", "事假", "年假", "婚假", "产假", "调休", "假", "假期"],
         "time": ["明天", "下周", "这周五", "下个月", "这个月底", "后天", "周一到周三", "两天", "一周"]},
    )],
    "CHECK_BENEFITS": [(
        ["我想了解{benefit_type}", "能告诉我{benefit_type}的详情吗？", "查询{benefit_type}信息",
         "我的{benefit_type}有哪些？", "请介绍一下{benefit_type}", "{benefit_type}怎么申请？",
         "我想知道{benefit_type}政策", "查看{benefit_type}说明", "{benefit_type}的标准是什么？",
         "公司的{benefit_type}如何？"],
        {"benefit_type": ["社保", "公积金", "保险", "福利待遇", "医疗保险", "年终奖", "餐补", "交通补贴",
                          "住房补贴", "培训福利"]},
    )],
    "IT_TICKET": [(
        ["我的{device}有{problem}", "{device}{problem}了，需要帮助", "IT支持：{device}{problem}",
         "电脑问题：{problem}", "我需要IT帮助，{device}{problem}", "{device}出现{problem}，怎么办？",
         "技术支持：{problem}", "帮忙解决{device}的{problem}", "{device}有故障：{problem}",
         "IT工单：{device}{problem}"],
        {"device": ["电脑", "笔记本", "打印机", "网络", "邮箱", "系统", "软件", "设备"],
         "problem": ["无法开机", "网络连接不上", "运行很慢", "死机", "无法打印", "登录不了", "崩溃", "出错"]},
    )],
    "EXPENSE_REIMBURSE": [(
        ["我需要报销{expense_type}", "申请{expense_type}报销", "我想报销{expense_type}费用",
         "{expense_type}怎么报销？", "报销申请：{expense_type}", "我要提交{expense_type}的报销单",
         "能帮我报销{expense_type}吗？", "{expense_type}报销流程是什么？", "我有{expense_type}需要报销",
         "请帮我处理{expense_type}报销"],
        {"expense_type": ["差旅费", "交通费", "餐费", "住宿费", "培训费", "办公用品", "通讯费", "会议费",
                          "招待费", "加班餐费"]},
    )],
    "COMPANY_LOOKUP": [(
        ["帮我介绍一下{company}", "帮我查询一下{company}", "我想了解{company}", "查询{company}的信息",
         "请介绍{company}", "{company}的详细信息", "我需要{company}的资料", "能告诉我{company}的情况吗？",
         "查看{company}的详情", "{company}是什么公司？"],
        {"company": ["数科公司", "通用技术集团数字智能科技有限公司", "数字智能科技有限公司", "集团公司",
                     "科技公司", "技术公司"]},
    )],
    "USER_LOOKUP": [
        (["帮我查询一下{person}", "查询{person}的信息", "我想了解{person}", "请查找{person}", "帮我找{person}"],
         {"person": ["张三", "孔文琦", "李四", "王五", "赵六", "陈七", "刘八", "马九"]}),
        (["帮我查询一下{person}，{name_clarification}", "查询{person}，{name_clarification}",
          "我要找{person}，{name_clarification}"],
         {"person": ["张三", "孔文琦", "李四", "王五", "赵六", "陈七", "刘八", "马九"],
          "name_clarification": ["张是弓长张", "琦是王字旁加奇怪的奇", "李是木子李", "王是三横一竖王"]}),
        (["查询{company}的{person}", "帮我查一下{company}的{person}", "我想了解{company}的{person}",
          "{company}有个{person}吗？"],
         {"company": ["数科公司", "通用技术集团数字智能科技有限公司", "公司"],
          "person": ["张三", "孔文琦", "李四", "王五", "赵六", "陈七", "刘八", "马九"]}),
        (["帮我查一下{company}{person}的{contact_type}", "查询{username}的{contact_type}",
          "{person}的{contact_type}是多少？", "我需要{person}的{contact_type}"],
         {"company": ["数科公司", "通用技术集团数字智能科技有限公司", "公司"],
          "person": ["张三", "孔文琦", "李四", "王五", "赵六", "陈七", "刘八", "马九"],
          "username": ["zhangsan1", "liwang2", "chenliu3", "maqian4", "user123", "test001"],
          "contact_type": ["手机号", "办公电话", "邮箱号码", "座机号", "电话号码", "联系方式"]}),
        (["帮我查一下{company}的{person}目前在哪个{org_unit}？", "{person}在{company}的{job_aspect}是什么？",
          "帮我查一下{company}{department}的{job_title}是谁", "帮我查询一下{company}{department}的人员有哪些？"],
         {"company": ["数科公司", "通用技术集团数字智能科技有限公司", "公司"],
          "person": ["张三", "孔文琦", "李四", "王五", "赵六", "陈七", "刘八", "马九"],
          "org_unit": ["部门", "科室", "事业部", "中心"],
          "job_aspect": ["职位", "岗位", "角色", "工作"],
          "department": ["管控数字化事业部", "综合办公室", "技术部", "市场部", "人事部", "财务部"],
          "job_title": ["总监", "总经理", "经理", "主任", "专员", "助理"]}),
        (["查询一下{company}{department}的{gender}员工都有谁", "帮我查询一下办公地点在{location}的{person}",
          "帮我查询一下{gender}的{person}", "办公地点在{location}的员工有哪些？"],
         {"company": ["数科公司", "通用技术集团数字智能科技有限公司", "公司"],
          "department": ["管控数字化事业部", "综合办公室", "技术部", "市场部", "人事部", "财务部"],
          "gender": ["男性", "女性"],
          "location": ["北京", "上海", "深圳", "杭州", "广州", "成都"],
          "person": ["张三", "孔文琦", "李四", "王五", "赵六", "陈七", "刘八", "马九"]}),
        (["{phone_number}是谁的{contact_type}？", "帮我查下{contact_type}尾号{phone_suffix}的用户是谁？",
          "这个{contact_type}{phone_number}是谁的？"],
         {"phone_number": ["13282814679", "81168151", "13912345678", "010-88888888", "0571-12345678"],
          "contact_type": ["手机号", "办公电话", "邮箱号码", "座机号", "电话号码", "联系方式"],
          "phone_suffix": ["2345", "8888", "1234", "6789", "0000"]}),
        (["查询{company}的通讯录", "帮我看一下{company}的员工名单", "{company}的联系人列表",
          "我需要{company}的人员信息"],
         {"company": ["数科公司", "通用技术集团数字智能科技有限公司", "公司"]}),
    ],
    "QUERY_RESPONSIBLE_PERSON": [(
        ["查{department}负责人", "查一下{company}的{responsible_role}", "告诉我{company}的{responsible_role}",
         "如何能找到{company}的{responsible_role}？", "{company}的{responsible_role}是谁",
         "{company}的{responsible_role}是谁？", "给我一下{company}{responsible_role}的{contact_info}",
         "查一下{company}{department}的{responsible_role}是谁", "查一下{company}{department}的{responsible_role}",
         "{company}{department}，谁负责？", "{company}{department}，谁说了算？",
         "帮我找一下{company}{department}的{responsible_role}", "我想找{company}{department}的{responsible_role}",
         "帮我查询一下{company}的{responsible_role}是谁", "我需要联系{company}的{responsible_role}",
         "怎么联系{company}的{responsible_role}？", "{company}的{responsible_role}有谁",
         "{company}的{responsible_role}是谁", "帮我查询一下{company}的{responsible_role}是谁",
         "{company}的{responsible_role}是谁", "查询{company}负责人的{contact_info}",
         "有{company}负责人的{contact_info}吗？", "{company}的负责人是谁？",
         "帮我找一下{company}的{responsible_role}", "帮我查一下{company}的{responsible_role}",
         "查询一下{company}{department}的负责人有谁", "列出{company}{department}的所有负责人",
         "帮我查下{company}{department}的{responsible_role}是谁",
         "{company}{department}的{responsible_role}叫什么名字？",
         "如何联系{company}{department}的{responsible_role}？", "{company}{department}的{responsible_role}是谁"],
        {"company": ["数科公司", "通用技术集团数字智能科技有限公司", "集团总部", "健康管理公司", "集团公司",
                     "数字智能科技有限公司"],
         "department": ["研发中心", "市场营销部", "管控数字化事业部", "财务部", "综合管理部", "技术部", "人事部"],
         "responsible_role": ["领导", "负责人", "决策人", "主要领导", "话事人", "管事人", "牵头人", "一把手",
                              "管理者", "拍板人", "主管领导", "老板", "老大", "头儿", "归口领导", "对接人"],
         "contact_info": ["邮箱", "电话", "联系方式", "手机号"]},
    )],
}

LABEL_ORDER = list(TEMPLATE_SETS)

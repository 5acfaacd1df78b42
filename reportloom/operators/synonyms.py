"""Synonyms of Chinese test-report terms, replaced one after another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms and the forms that stand for them, in the order of replacement; a term that comes again keeps its place and takes
#: the later form. Fixed values.
SYNONYMS = [
    ("一般規定", "一般要求"),
    ("規定", "要求"),
    ("概述", "一般"),
    ("安全防護", "要求"),
    ("保護方法", "安全防護方法"),
    ("PS和PIS的分類", "電力能量源(PS)及潛在起火源(PIS)之分級"),
    ("分類", "分級"),
    ("測試", "試驗"),
    ("試驗方法", "試驗方法"),
    ("標示永久性試驗", "標示耐久性試驗"),
    ("電壓浪湧試驗", "電壓浪湧試驗"),
    ("單一故障條件", "試驗方法"),
    ("電動機", "馬達"),
    ("間隙", "淨空間隔"),
    ("爬電距離", "沿面距離"),
    ("熱連結", "溫度熔線"),
    ("熱熔斷體", "溫度熔線"),
    ("壓敏電阻", "變阻器"),
    ("有限功率源", "電力限制型電源"),
    ("保持通電的部件", "殘留能量之部件"),
    ("熱保護", "過熱保護"),
    ("浪湧", "突波"),
    ("元件", "組件"),
    ("防護措施", "安全防護"),
    ("配線", "接線"),
    ("佈線", "配線"),
    ("標記", "標示"),
    ("可辨識性", "清晰度"),
    ("耐用性", "耐久性"),
    ("永久性", "持久性"),
    ("危害物質", "有害物質"),
    ("機械性", "機械"),
    ("應力消除", "抗拉力"),
    ("機構", "機制"),
    ("故障", "失效"),
    ("防潮保護", "防止濕氣"),
    ("開口", "開孔"),
    ("特性", "性質"),
    ("聽力設備", "收聽設備"),
    ("類比", "模擬"),
    ("有線", "有線"),
    ("墊圈", "密封墊片"),
    ("溢出後果之判定", "決定噴濺後果"),
    ("銳利邊緣或尖角", "銳邊或切角"),
    ("無絕緣擊穿", "不得有絕緣崩潰"),
    ("永久性", "耐久性"),
    ("突波保護裝置", "SPD"),
    ("間隙和試驗電壓的乘數", "超過海拔2,000 m之乘數因子"),
    ("安全防護方法", "保護方法"),
    ("可燃材料與PIS的分離", "PIS與可燃性材料之隔離"),
    ("作為斷開裝置的開關", "開關用作切離裝置"),
    ("作為斷開裝置的插頭", "插頭用作切離裝置"),
    ("斷開裝置", "切離裝置"),
    ("從電源斷開", "自電源切離"),
    ("斷開", "切離"),
    ("具有機電裝置用於銷毀介質的設備", "設備具有破壞介質之電機裝置"),
    ("未特別涵蓋的構造和元件", "未明確規定之結構與組件"),
    ("通風試驗", "排氣試驗"),
    ("替代方法", "方案"),
    ("含有鈕扣/硬幣型電池的設備", "設備包含鋰電池或鈕扣型電池之電池組"),
    ("多個電源", "多電源組"),
    ("防止電解液溢出", "電解液洩漏之保護"),
    ("電解液溢出", "電解液洩漏"),
    ("管和半導體中電極的短路", "半導體及真空管中電極之短路"),
    ("無源元件", "被動組件"),
    ("不可復位裝置", "無法重置的保護裝置"),
    ("額定值和標記", "額定和標示"),
    ("形成膠合接頭的絕緣化合物", "絕緣化合物形成接合劑接合"),
    ("滑軌安裝設備", "機架安裝式設備"),
    ("SRME", "SRME"),
    ("FIW", "完全絕緣繞組線"),
    ("帶類比輸入的有線聽力設備", "收聽設備"),
    ("電源電壓和公差", "電源電壓容許值"),
    ("防止電能來源", "針對電氣能量源之保護"),
    ("PS和PIS之分類", "電力能量源(PS)及潛在起火源(PIS)之分級"),
    ("熱灼傷", "熱能燒燙傷害"),
    ("溫度測量條件", "溫度量測條件"),
    ("測量", "量測"),
    ("電壓測量", "量測電壓"),
    ("未特別涵蓋的結構和元件", "未明確規定之結構與組件"),
    ("涵蓋", "規定"),
    ("結構", "結構"),
    ("尺寸可變的變壓器絕緣", "變壓器內具不同尺度之絕緣"),
    ("繞線元件中的電線絕緣", "繞線式組件中之繞線絕緣"),
    ("防止過度灰塵", "過量灰塵之防護"),
    ("玻璃衝擊試驗", "玻璃撞擊試驗"),
    ("衝擊", "撞擊"),
    ("扭矩", "轉矩"),
    ("維卡試驗", "軟化(Vicat)試驗"),
    ("確定空間距離的程序", "程序決定空間距離"),
    ("確定", "決定"),
    ("重新定位穩定性", "搬移穩定性"),
    ("試驗設備", "試驗儀器"),
    ("覆蓋系統", "解除系統"),
    ("市電器具插座和插座標示", "電源裝置插座與插座插座之標示"),
    ("市電", "主電源"),
    ("點燃", "點火"),
    ("可達", "可達到"),
    ("無點燃且可達溫度值", "無點火和可達到的溫度值"),
    ("外部火花源點燃", "外部火花源導致之內部點燃"),
    ("瞬態電壓", "暫態電壓"),
    ("測定沿面距離的程序", "程序決定空間距離"),
    ("測定", "決定"),
    ("沿面距離", "空間距離"),
    ("防護螢幕", "保護屏幕"),
    ("限制功率源", "電力限制型電源"),
    ("防止", "防護"),
    ("形成固體絕緣的絕緣化合物", "絕緣化合物形成固體絕緣"),
    ("帶數位輸入的有線聽力設備", "有線數位輸入之收聽裝置"),
    ("電源電壓和容差", "電源電壓容許值"),
    ("重複脈衝限制", "連續性脈衝之限制值"),
    ("更換保險絲識別和額定值標示", "可替換式熔線識別及額定值標示"),
    ("防止植物和害蟲", "植物及害蟲之防護"),
    ("與建築物佈線互連的要求", "互連至建築物配線之要求"),
    ("滑軌末端擋塊的完整性", "滑軌終端停止裝置之完整性"),
    ("針對熱能來源的安全防護", "防止熱能量源之安全保護"),
    ("型號識別", "機型識別"),
    ("標示的耐久性、清晰度和永久性", "標示之耐用性、可辨識性及永久性"),
    ("繞組纏繞在金屬或鐵氧體磁芯上的", "纏繞在金屬或鐵心上之"),
    ("用於連接剝線的端子", "用作裸線連接之端子"),
    ("作為補充安全防護一部分的內部電線絕緣", "內部線材絕緣用作補充安全防護之一部分"),
    ("樣品製備和初步檢查", "準備樣品及初步檢驗"),
    ("內部可觸及安全防護試驗", "內部可觸及的安全防護試驗"),
    ("保險絲", "熔線"),
    ("無源元件", "被動組件"),
    ("間隙和試驗電壓的乘數", "超過海拔2,000 m之乘數因子"),
    ("控制火勢蔓延", "火災蔓延控制"),
    ("火勢", "火災"),
    ("火災蔓延控制", "保護方法"),
    ("電池內部因外部火花源引起燃燒", "電池組因外部火花源導致之內部點燃"),
    ("引起燃燒", "點燃"),
    ("含水電解液", "含液態電解質"),
    ("電解液", "電解質"),
]


def apply_synonyms(c: Column) -> Column:
    """All replacements in order, each over the result of the one before."""
    rules = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in dict(SYNONYMS).items()])
    return F.aggregate(rules, c, lambda text, rule: F.replace(text, rule["old"], rule["new"]))

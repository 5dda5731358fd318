"""Phrases of safety language in other languages, and their English."""

# Phrases of reports and what stands for them.
KANNADA = {
    "ಸೀಮಿತ ಸ್ಥಳ": "confined space", "ಕನ್ಫೈನ್ಡ್ ಸ್ಪೇಸ್": "confined space", "ಗ್ಯಾಸ್ ಪರೀಕ್ಷೆ": "gas testing", "ವಾತಾವರಣ ಪರೀಕ್ಷೆ": "atmospheric testing",
    "ಪ್ರವೇಶ ಅನುಮತಿ": "entry permit", "ಅನುಮತಿ ಇಲ್ಲದೆ": "without permit", "ಪ್ರವೇಶಿಸಿದರು": "entered", "ಕಾರ್ಮಿಕ": "worker", "ಕಾರ್ಮಿಕರು": "workers",
    "ಶಕ್ತಿ ಪ್ರತ್ಯೇಕತೆ": "energy isolation", "ಲಾಕ್ ಔಟ್": "lockout", "ಟ್ಯಾಗ್ ಔಟ್": "tagout", "ವಿದ್ಯುತ್ ಕೆಲಸ": "electrical work",
    "ವಿದ್ಯುತ್ ಸಂಪರ್ಕ": "electrical connection", "ಪ್ರತ್ಯೇಕಿಸದೆ": "without isolation", "ಪ್ರತ್ಯೇಕಿಸಲಿಲ್ಲ": "not isolated", "ಶಕ್ತಿ ಮೂಲ": "energy source",
    "ಬಿಸಿ ಕೆಲಸ": "hot work", "ವೆಲ್ಡಿಂಗ್": "welding", "ಕಟ್ಟಿಂಗ್": "cutting", "ಗ್ರೈಂಡಿಂಗ್": "grinding", "ಅನುಮತಿ ಪತ್ರ": "permit", "ಬೆಂಕಿ ಕಾವಲು": "fire watch",
    "ಬೆಂಕಿ ನಿರ್ವಹಣೆ": "fire control", "ಎತ್ತರದಲ್ಲಿ ಕೆಲಸ": "working at height", "ಹಾರ್ನೆಸ್ ಇಲ್ಲದೆ": "without harness", "ರಕ್ಷಣಾ ಉಪಕರಣ": "protective equipment",
    "ಸ್ಕ್ಯಾಫೋಲ್ಡ್": "scaffold", "ಏಣಿ": "ladder", "ಸೂಕ್ತ ಉಪಕರಣ ಇಲ್ಲದೆ": "without ppe", "ಪಿಪಿಇ ಧರಿಸದೆ": "without ppe",
    "ವೈಯಕ್ತಿಕ ರಕ್ಷಣಾ": "personal protective equipment", "ಕ್ರೇನ್": "crane", "ಅಮಾನತು ಲೋಡ್": "suspended load", "ಹೊರಗಿನ ವಲಯ": "exclusion zone",
    "ವಾಹನ": "vehicle", "ಫೋರ್ಕ್ಲಿಫ್ಟ್": "forklift", "ಪಾದಚಾರಿ": "pedestrian", "ಅಪಘಾತ": "incident", "ಅಸುರಕ್ಷಿತ": "unsafe", "ಸಮೀಪ ತಪ್ಪಿಸಿಕೊಂಡ": "near miss",
    "ತೀವ್ರ ಗಾಯ": "serious injury", "ಸಾವು": "fatality", "ಸುರಕ್ಷತೆ": "safety", "ಅಪಾಯ": "hazard", "ಸಿಬ್ಬಂದಿ": "personnel", "ನಿರ್ವಾಹಕ": "operator",
    "ತಂತ್ರಜ್ಞ": "technician", "ತನಿಖಾಧಿಕಾರಿ": "inspector", "ಮೇಲ್ವಿಚಾರಕ": "supervisor", "ದೋಷ": "failure", "ನಿಯಂತ್ರಣ": "control", "ಕ್ರಮ": "action",
}
HINDI = {
    "सीमित स्थान": "confined space", "कंफाइन्ड स्पेस": "confined space", "गैस परीक्षण": "gas testing", "वायुमंडलीय परीक्षण": "atmospheric testing",
    "प्रवेश अनुमति": "entry permit", "बिना अनुमति": "without permit", "अनुमति के बिना": "without permit", "प्रवेश किया": "entered", "श्रमिक": "worker",
    "मजदूर": "worker", "श्रमिकों": "workers", "ऊर्जा अलगाव": "energy isolation", "एनर्जी आइसोलेशन": "energy isolation", "लॉकआउट": "lockout",
    "टैगआउट": "tagout", "लॉक आउट": "lockout", "विद्युत कार्य": "electrical work", "बिजली का काम": "electrical work", "बिना आइसोलेट": "without isolation",
    "आइसोलेट किए बिना": "without isolation", "ऊर्जा स्रोत": "energy source", "विद्युत लाइन": "electrical line", "हॉट वर्क": "hot work",
    "गर्म काम": "hot work", "वेल्डिंग": "welding", "कटिंग": "cutting", "ग्राइंडिंग": "grinding", "अनुमति पत्र": "permit", "अग्नि सुरक्षक": "fire watch",
    "अग्निशामक": "fire extinguisher", "ऊंचाई पर काम": "working at height", "हार्नेस के बिना": "without harness", "सुरक्षा उपकरण": "safety equipment",
    "सुरक्षा उपकरण के बिना": "without safety equipment", "स्कैफोल्ड": "scaffold", "सीढ़ी": "ladder", "पीपीई के बिना": "without ppe",
    "व्यक्तिगत सुरक्षा": "personal protective equipment", "सुरक्षात्मक उपकरण": "protective equipment", "क्रेन": "crane", "निलंबित भार": "suspended load",
    "बहिष्करण क्षेत्र": "exclusion zone", "वाहन": "vehicle", "फोर्कलिफ्ट": "forklift", "पैदल यात्री": "pedestrian", "रासायनिक": "chemical", "एसिड": "acid",
    "विषाक्त": "toxic", "दुर्घटना": "incident", "असुरक्षित": "unsafe", "निकट चूक": "near miss", "गंभीर चोट": "serious injury", "मृत्यु": "fatality",
    "सुरक्षा": "safety", "खतरा": "hazard", "कर्मी": "personnel", "ऑपरेटर": "operator", "तकनीशियन": "technician", "पर्यवेक्षक": "supervisor",
    "विफलता": "failure", "नियंत्रण": "control", "कार्रवाई": "action", "काम किया": "worked", "बिना": "without", "किए बिना": "without",
}

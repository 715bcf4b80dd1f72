"""Minimal Office packages written with zipfile (no office library needed)."""

import os
import zipfile
from xml.sax.saxutils import escape

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def _para(text, style=None, bold=False):
    ppr = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    rpr = "<w:rPr><w:b/></w:rPr>" if bold else ""
    return f"<w:p>{ppr}<w:r>{rpr}<w:t xml:space=\"preserve\">{escape(text)}</w:t></w:r></w:p>"


def _tc(text, span=1, vmerge=None):
    pr = ""
    if span > 1 or vmerge:
        pr = "<w:tcPr>" + (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + \
             (f'<w:vMerge w:val="{vmerge}"/>' if vmerge == "restart" else ("<w:vMerge/>" if vmerge else "")) + "</w:tcPr>"
    return f"<w:tc>{pr}<w:p><w:r><w:t>{escape(text)}</w:t></w:r></w:p></w:tc>"


def write_docx(path):
    body = "".join([
        _para("Intro text"),
        _para("Goods in", "Heading2"),
        _para("Two vans unloaded", bold=True),
        "<w:tbl><w:tr>" + _tc("Haulier and depot", span=2) + _tc("Rhine Cargo") + "</w:tr>"
        "<w:tr>" + _tc("Total", vmerge="restart") + _tc("") + _tc("42") + "</w:tr>"
        "<w:tr>" + _tc("", vmerge="continue") + _tc("x") + _tc("43") + "</w:tr></w:tbl>",
        _para(""),
        _para("Goods out", "Heading2"),
        _para("nothing today"),
    ])
    styles = (f'<w:styles {W}><w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style>'
              f'<w:style w:styleId="Normal"><w:name w:val="Normal"/></w:style></w:styles>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)


def write_pptx(path):
    def sp(*paras):
        ps = "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in paras)
        return f"<p:sp><p:txBody>{ps}</p:txBody></p:sp>"
    tbl = ("<p:graphicFrame><a:graphic><a:graphicData><a:tbl>"
           "<a:tr><a:tc><a:txBody><a:p><a:r><a:t>Key</a:t></a:r></a:p></a:txBody></a:tc>"
           "<a:tc><a:txBody><a:p><a:r><a:t>Value 1</a:t></a:r></a:p></a:txBody></a:tc></a:tr>"
           "</a:tbl></a:graphicData></a:graphic></p:graphicFrame>")
    slide1 = f"<p:sld {P} {A}><p:cSld><p:spTree>{sp('Title one', '  ', 'Second line')}{tbl}</p:spTree></p:cSld></p:sld>"
    slide2 = f"<p:sld {P} {A}><p:cSld><p:spTree>{sp('Slide two text')}</p:spTree></p:cSld></p:sld>"
    notes = (f"<p:notes {P} {A}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type=\"body\"/></p:nvPr></p:nvSpPr>"
             "<p:txBody><a:p><a:r><a:t>Speaker detail</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:notes>")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("ppt/presentation.xml",
                   f'<p:presentation {P} {R}><p:sldIdLst><p:sldId id="256" r:id="rId2"/>'
                   f'<p:sldId id="257" r:id="rId3"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels",
                   f'<Relationships {REL}><Relationship Id="rId2" Type="x/slide" Target="slides/slide1.xml"/>'
                   f'<Relationship Id="rId3" Type="x/slide" Target="slides/slide2.xml"/></Relationships>')
        z.writestr("ppt/slides/slide1.xml", slide1)
        z.writestr("ppt/slides/slide2.xml", slide2)
        z.writestr("ppt/slides/_rels/slide2.xml.rels",
                   f'<Relationships {REL}><Relationship Id="rId1" Type="x/notesSlide" '
                   f'Target="../notesSlides/notesSlide1.xml"/></Relationships>')
        z.writestr("ppt/notesSlides/notesSlide1.xml", notes)


def write_xlsx(path):
    sheet1 = (f"<worksheet {S}><sheetData>"
              '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
              '<row r="3"><c r="A3" t="inlineStr"><is><t>Total</t></is></c><c r="B3"><v>12.5</v></c>'
              '<c r="C3"><f>SUM(B3)</f></c></row>'
              "</sheetData></worksheet>")
    sheet2 = f'<worksheet {S}><sheetData><row r="6"><c r="F6"><v>7</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml",
                   f'<workbook {S} {R}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/>'
                   f'<sheet name="Stock" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   f'<Relationships {REL}><Relationship Id="rId1" Type="x/worksheet" Target="worksheets/sheet1.xml"/>'
                   f'<Relationship Id="rId2" Type="x/worksheet" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {S}><si><t>Name</t></si><si><t>Amount</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet1)
        z.writestr("xl/worksheets/sheet2.xml", sheet2)


def write_folder(root):
    proj = os.path.join(root, "depot")
    os.makedirs(proj, exist_ok=True)
    write_docx(os.path.join(proj, "day book.docx"))
    write_pptx(os.path.join(proj, "tour.pptx"))
    write_xlsx(os.path.join(proj, "stock.xlsx"))
    with open(os.path.join(proj, "broken.docx"), "wb") as fh:
        fh.write(b"not a zip")
    with open(os.path.join(proj, "old.doc"), "wb") as fh:
        fh.write(b"legacy")
    with open(os.path.join(proj, "~$lock.docx"), "wb") as fh:
        fh.write(b"lock")
    return root


def _row(*cells):
    return "<w:tr>" + "".join(_tc(c) for c in cells) + "</w:tr>"


def _row(*cells):
    return "<w:tr>" + "".join(_tc(c) for c in cells) + "</w:tr>"


def write_depot_folder(root):
    """A day at a depot: a log with a table, a hand-over note and the stock workbook."""
    proj = os.path.join(root, "tuesday")
    os.makedirs(proj, exist_ok=True)
    log = "".join([
        _para("Shift: early   Foreman: R. Okafor   Bay: 7"),
        _para("Goods in", "Heading2"),
        _para("Two vans unloaded"),
        "<w:tbl>" + _row("Pallets", "", "31") + _row("Remarks: one pallet wet") + "</w:tbl>",
        _para("Goods out", "Heading2"),
        _para("Nothing left the yard"),
    ])
    note = "".join([_para("Hand-over", "Heading1"), "<w:tbl>" + _row("Keys", "with the porter") + "</w:tbl>",
                    _para("Forklift 2 needs oil"), _para("Gate code unchanged")])
    styles = (f'<w:styles {W}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style>'
              f'<w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style></w:styles>')
    for name, body in (("Log 12.docx", log), ("Note 12.docx", note)):
        with zipfile.ZipFile(os.path.join(proj, name), "w") as z:
            z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
            z.writestr("word/styles.xml", styles)
    write_xlsx(os.path.join(proj, "stock 12.xlsx"))
    return root
